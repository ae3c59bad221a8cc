"""Sources, streams and simulations over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions import calendar as K
from tidebar.functions import prices as P
from tidebar.functions.shared import percentiles, shared_dir, written
from tidebar.operators import momentum as M
from tidebar.operators import simulate as X
from tidebar.plans import query
from tidebar.plans.indicators import BARS, r6
from tidebar.plans.markets import PANEL, panel
from tidebar.sources import packed, providers
from tidebar.sources.views import DAY, HOUR, bars, bars_sql, epoch_s, epoch_us, table, ticks
from tidebar.streaming import live

_F32 = ", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in ("open", "high", "low", "close", "volume"))


@query("packed_round_trip", f"WITH {BARS} SELECT symbol, 3600 AS res_secs, ts_ms, {_F32}, trades FROM bars")
def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpacked(packed.packed(bars(spark, sf), 3600)).drop("vwap")


@query(
    "journal_replay",
    """SELECT user_id::VARCHAR AS symbol, event_id % 2 AS res, max(event_id) AS bars FROM events GROUP BY 1, 2""",
)
def journal_replay(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events")
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("symbol"), (F.col("event_id") % 2).alias("res"), F.col("event_id").alias("bars")))
    torn = own.select((F.col("event_id") + 0.5).alias("nth"), F.substring(record, 1, 20).alias("value")).where("nth % 50 < 1")
    lines = own.select(F.col("event_id").cast("double").alias("nth"), record.alias("value")).unionByName(torn)
    return packed.replay_journal(lines, "symbol string, res long, bars long", ["symbol", "res"]).select("symbol", "res", "bars")


@query(
    "chart_bars",
    f"""WITH {bars_sql(DAY)} SELECT symbol, ts_ms, round(open / 2, 6) AS open, round(high / 2, 6) AS high, round(low / 2, 6) AS low,
        round(close / 2, 6) AS close, volume, round((high + low + close) / 6, 6) AS vwap, 0::BIGINT AS trades FROM bars""",
)
def chart_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars as a provider's parallel arrays, halved by their dividend factor."""
    own = bars(spark, sf, DAY).withColumn("adjclose", F.col("close") / 2)
    names = ("ts_ms", "open", "high", "low", "close", "volume", "adjclose")
    rows = own.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    charts = rows.select("symbol", F.transform("r", lambda x: F.floor(x["ts_ms"] / 1000)).alias("timestamp"), *(pick(c).alias(c) for c in names[1:]))
    found = providers.chart_bars(charts, 4_000_000_000)
    return found.withColumns({c: r6(c) for c in ("open", "high", "low", "close", "vwap")})


_SESSIONS = K.sessions_sql("1995-01-01", "2001-12-31")


@query(
    "trading_days",
    f"""WITH {_SESSIONS}, own AS (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1)
        SELECT day, coalesce(orders, 0)::BIGINT AS orders FROM sessions LEFT JOIN own USING (day)""",
)
def trading_days(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by trading day: days without a session have none."""
    days = K.sessions(spark, "1995-01-01", "2001-12-31")
    own = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return days.join(own, "day", "left").select("day", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query(
    "release_sessions",
    f"""WITH {_SESSIONS}, own AS (SELECT DISTINCT o_orderdate::DATE AS released FROM orders)
        SELECT released, (SELECT min(day) FROM sessions WHERE day > released AND day <= released + 11) AS available_day FROM own""",
)
def release_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The first session after each order's day."""
    days = K.sessions(spark, "1995-01-01", "2001-12-31")
    own = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("released")).distinct()
    return K.available_at(own, days)


STREAMED = f"""{BARS}, rolled AS (SELECT symbol, ts_ms // {HOUR} AS bucket, close, lead(ts_ms // {HOUR}) OVER (PARTITION BY symbol ORDER BY ts_ms) AS later FROM bars),
    done AS (SELECT symbol, bucket, close FROM rolled WHERE later = bucket + 1)"""


def streamed_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files, folded to completed buckets in a table of the shared folder."""
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    own = source.select(
        F.col("event_type").alias("symbol"), epoch_us(F.col("ts")).alias("seq"), F.col("event_id").alias("tie"), epoch_s(F.col("ts")).alias("ts_s"), F.col("value").alias("close")
    )
    root = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    sink = live.buckets(own, HOUR // 1000).writeStream.format("parquet").option("path", f"{root}/bars")
    run = sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(live.BUCKETS).parquet(f"{root}/bars")


@query("live_bars", f"WITH {STREAMED} SELECT symbol, bucket, close FROM done")
def live_bars(spark: SparkSession, sf: str) -> DataFrame:
    return streamed_bars(spark, sf).where("kind = 'bar'").select("symbol", "bucket", "close")


@query("live_barrier", f"WITH {STREAMED} SELECT bucket, round(sum(close), 6) AS total FROM done GROUP BY 1 HAVING count(DISTINCT symbol) = 5")
def live_barrier(spark: SparkSession, sf: str) -> DataFrame:
    found = live.barrier(streamed_bars(spark, sf), 5)
    return found.select("bucket", r6(F.aggregate(F.map_values("closes"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    "last_closes",
    """SELECT event_type AS symbol, (epoch_ms(ts) // 300000) * 300 AS bucket_s, last(value ORDER BY ts, event_id) AS close, count(*) AS ticks
       FROM events WHERE value > 0 AND value < 'Infinity'::DOUBLE GROUP BY 1, 2""",
)
def last_closes(spark: SparkSession, sf: str) -> DataFrame:
    own = ticks(spark, sf).withColumn("ts_s", F.struct("ts_ms", "seq"))
    bucket = F.floor(F.col("ts_ms") / 300_000) * 300
    return own.groupBy("symbol", bucket.cast("long").alias("bucket_s")).agg(F.max_by("price", "ts_s").alias("close"), F.count("*").alias("ticks"))


@query("rebalanced_backtest")
def rebalanced_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """A book of names in proportion to how far they fell in the last hour, rebalanced at the next opens."""
    own = bars(spark, sf).withColumn("_r", M.log_return())
    return X.pnl_reward(X.backtest(X.steps_of(own, -F.col("_r"))))


@query(
    "trailing_dollars",
    f"""WITH {BARS} SELECT symbol, ts_ms, count(*) OVER w AS bars, round(sum(close * volume) OVER w, 4) AS dollars
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def trailing_dollars(spark: SparkSession, sf: str) -> DataFrame:
    before = M.by().rowsBetween(W.unboundedPreceding, -1)
    dollars = F.round(F.sum(F.col("close") * F.col("volume")).over(before), 4)
    return bars(spark, sf).select("symbol", "ts_ms", F.count("*").over(before).alias("bars"), dollars.alias("dollars"))


@query(
    "closure_kelly",
    f"""WITH {BARS}, laws AS (
            SELECT symbol, avg(r) AS mu, var_samp(r) AS v FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) / 100 AS r FROM bars) GROUP BY 1)
        SELECT symbol, round(least(greatest((exp(mu + v / 2) - 1) / (exp(2 * mu + 2 * v) - 2 * exp(mu + v / 2) + 1), -5), 5), 5) AS fraction FROM laws""",
)
def closure_kelly(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).withColumn("_r", M.log_return() / 100)
    laws = own.groupBy("symbol").agg(F.avg("_r").alias("mu"), F.var_samp("_r").alias("v"))
    return laws.select("symbol", F.round(P.closure_kelly(F.col("mu"), F.col("v"), 5.0), 5).alias("fraction"))


@query(
    "quantile_bands",
    f"""WITH {BARS}, h AS (SELECT (ts_ms // {HOUR}) % 24 AS horizon, close FROM bars)
        SELECT horizon, round(quantile_cont(close, 0.05), 6) AS p05, round(quantile_cont(close, 0.5), 6) AS p50, round(quantile_cont(close, 0.95), 6) AS p95 FROM h GROUP BY 1""",
)
def quantile_bands(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).withColumn("horizon", (F.floor(F.col("ts_ms") / HOUR) % 24).cast("long"))
    cuts = percentiles(own, "close", [0.05, 0.5, 0.95], ("horizon",))
    return cuts.select("horizon", *(r6(F.col("cuts")[k]).alias(n) for k, n in enumerate(("p05", "p50", "p95"))))


@query(
    "explained_variance",
    f"""WITH {BARS}, p AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms) AS guess FROM bars)
        SELECT symbol, round(1 - var_pop(guess - close) / var_pop(close), 6) AS explained FROM p WHERE guess IS NOT NULL GROUP BY 1""",
)
def explained_variance(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).withColumn("guess", F.lag("close").over(M.by())).where("guess IS NOT NULL")
    share = F.try_divide(F.var_pop(F.col("guess") - F.col("close")), F.var_pop("close"))
    return own.groupBy("symbol").agg(r6(1 - share).alias("explained"))


@query(
    "break_even_cost",
    f"""WITH RECURSIVE {PANEL}, own AS MATERIALIZED (
            SELECT t, avg(exp(realized_r) - 1) AS gross, count(*) / 5.0::DOUBLE AS turnover FROM panel GROUP BY 1
        ), ends AS (
            SELECT sum(ln(greatest(1 + gross, 1e-12))) AS free, sum(ln(greatest(1 + gross - turnover * 0.1::DOUBLE, 1e-12))) AS dear FROM own
        ), walk AS (
            SELECT 0 AS k, 0.0::DOUBLE AS a, 1000.0::DOUBLE AS b
            UNION ALL
            SELECT k + 1, CASE WHEN up THEN (a + b) / 2 ELSE a END, CASE WHEN up THEN b ELSE (a + b) / 2 END FROM (
                SELECT *, (SELECT sum(ln(greatest(1 + gross - turnover * ((a + b) / 2 / 10000), 1e-12))) FROM own) > 0 AS up FROM walk WHERE k < 48))
        SELECT round(CASE WHEN free <= 0 THEN 0 WHEN dear > 0 THEN 'Infinity'::DOUBLE ELSE (a + b) / 2 END, 6) AS bps FROM walk, ends WHERE k = 48""",
)
def break_even_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The flat cost at which an equal book of all names stops growing; one row."""
    own = panel(spark, sf).groupBy("t").agg(F.avg(F.expm1("realized_r")).alias("gross_r"), (F.count("*") / 5).alias("turnover"))
    return spark.createDataFrame([(round(X.break_even_bps(written(own, "book")), 6),)], "bps double")
