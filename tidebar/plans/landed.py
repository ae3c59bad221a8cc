"""Landed documents, appended tables, feeds, scores of discrete forecasts, breaks of identity and other reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions import prices as P
from tidebar.functions.shared import shared_dir
from tidebar.operators import evaluate as V
from tidebar.operators import factors as A
from tidebar.operators import momentum as M
from tidebar.operators import quality as Q
from tidebar.operators import reports as R
from tidebar.operators import support as B
from tidebar.operators import universe as U
from tidebar.plans import query
from tidebar.plans.indicators import BARS, r6
from tidebar.plans.pointintime import MIDDLE
from tidebar.sources import packed, providers
from tidebar.sources.views import DAY, HOUR, arrival, bars, bars_sql, epoch_ms, epoch_s, resample, table
from tidebar.streaming import live

USER_DAYS = bars_sql(DAY, "user_id", "days")


@query(
    "aggregate_bars",
    f"""WITH {BARS} SELECT symbol, ts_ms, open, high, low, close, volume,
            round(coalesce(CASE WHEN trades > 1 THEN vwap END, (high + low + close) / 3), 6) AS vwap,
            (CASE WHEN trades > 1 THEN trades ELSE 0 END)::BIGINT AS trades FROM bars""",
)
def aggregate_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as a provider sends them, which leaves vw and n out where one trade makes a bar."""
    several = lambda c: F.when(F.col("trades") > 1, F.col(c))
    sent = bars(spark, sf).select(
        "symbol", F.col("ts_ms").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").alias("v"), several("vwap").alias("vw"), several("trades").alias("n"),
    )
    return providers.aggregate_bars(sent).withColumn("vwap", r6("vwap"))


@query("fetched_history", f"WITH {BARS} SELECT symbol, ts_ms, close FROM bars WHERE ts_ms + {HOUR} <= {MIDDLE + 3 * DAY + HOUR // 2}")
def fetched_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two fetched windows that overlap by a day, put together."""
    own = bars(spark, sf).select("symbol", "ts_ms", "close")
    windows = own.where(F.col("ts_ms") < MIDDLE).unionByName(own.where(F.col("ts_ms") >= MIDDLE - DAY))
    return providers.history(windows, MIDDLE + 3 * DAY + HOUR // 2, HOUR)


@query(
    "series_observations",
    """SELECT o_orderpriority AS series, o_orderdate::DATE AS period, (o_orderdate::DATE + 1) AS released,
              CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders""",
)
def series_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as text, a point where there is no value."""
    day = F.to_date("o_orderdate")
    value = F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string"))
    raw = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), day.cast("string").alias("date"),
        F.date_add(day, 1).cast("string").alias("realtime_start"), value.alias("value"),
    )
    return providers.check_observations(providers.observations(raw))


@query(
    "usable_bars",
    f"""WITH raw AS (
            SELECT user_id::VARCHAR AS symbol, ((epoch_ms(ts) // {DAY}) * {DAY})::BIGINT AS ts_ms, first(value ORDER BY ts, event_id) AS open,
                   max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)
        SELECT symbol, ts_ms, open, high, low, close FROM raw WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND ts_ms + {DAY} <= {MIDDLE}""",
)
def usable_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Days of all events, those without a price above 0 among them, as far as bars of them can be used."""
    every = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), epoch_ms(F.col("ts")).alias("ts_ms"), F.col("value").alias("price"),
        F.lit(1.0).alias("size"), arrival(F.col("ts"), F.col("event_id")).alias("seq"),
    )
    return Q.usable(resample(every, DAY), MIDDLE, DAY).select("symbol", "ts_ms", "open", "high", "low", "close")


@query("appended_bars", f"WITH {BARS} SELECT symbol, 3600 AS res_secs, ts_ms, close, trades FROM bars")
def appended_bars(spark: SparkSession, sf: str) -> DataFrame:
    """A table of bars, written and then appended to by a fetch that reaches back into it; no bar stands twice."""
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    own = bars(spark, sf).withColumn("res_secs", F.lit(3600))
    packed.write_bars(own.where(F.col("ts_ms") < MIDDLE), path)
    packed.append_bars(spark, path, own)
    return spark.read.parquet(path).select("symbol", "res_secs", "ts_ms", "close", "trades")


@query(
    "covered_symbols",
    f"""WITH {BARS}, entries AS (
            SELECT symbol, count(*) AS bars, max(ts_ms) AS last_ts_ms, min(ts_ms) AS requested_from_ms, symbol = 'view' AS delisted FROM bars GROUP BY 1)
        SELECT symbol, bars, last_ts_ms FROM entries WHERE bars > 0 AND (delisted OR last_ts_ms >= {MIDDLE}) AND requested_from_ms <= {MIDDLE - 7 * DAY}""",
)
def covered_symbols(spark: SparkSession, sf: str) -> DataFrame:
    entries = bars(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.max("ts_ms").alias("last_ts_ms"), F.min("ts_ms").alias("requested_from_ms")
    )
    entries = entries.withColumn("delisted", F.col("symbol") == "view")
    return packed.covered(entries, MIDDLE, MIDDLE - 7 * DAY).select("symbol", "bars", "last_ts_ms")


NOW_S = (MIDDLE + 14 * DAY) // 1000


@query(
    "feed_health",
    f"""WITH latest AS (
            SELECT user_id::VARCHAR AS symbol, max(epoch_ms(ts) // 1000)::BIGINT AS ts_s, max(epoch_ms(ts) // 1000 + event_id % 5)::BIGINT AS received_s
            FROM events GROUP BY 1)
        SELECT *, CASE WHEN ts_s > {NOW_S + 15} THEN 'ahead' WHEN {NOW_S} - received_s > 86400 THEN 'silent'
                       WHEN {NOW_S} - ts_s > 86400 THEN 'stale' ELSE 'ok' END AS state FROM latest""",
)
def feed_health(spark: SparkSession, sf: str) -> DataFrame:
    at = epoch_s(F.col("ts"))
    latest = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), at.alias("ts_s"), (at + F.col("event_id") % 5).alias("received_s")
    )
    return live.feed_health(latest, NOW_S, 86_400)


_SHARES = ", ".join(f"count(*) FILTER (k = {j}) / count(*)::DOUBLE AS {{0}}{j}" for j in range(4))
_CRPS = " + ".join(f"power({' + '.join(f'p{i}' for i in range(j + 1))} - (b <= {j})::INTEGER, 2) * {j + 1}" for j in range(4))
_KL = " + ".join(f"CASE WHEN p{j} > 0 THEN p{j} * ln(p{j} / greatest(q{j}, 1e-12)) ELSE 0 END" for j in range(4))


@query(
    "pmf_scores",
    f"""WITH k AS (SELECT user_id, hour(ts) // 6 AS k FROM events), p AS (SELECT user_id, user_id % 4 AS b, {_SHARES.format("p")} FROM k GROUP BY 1),
             q AS (SELECT {_SHARES.format("q")} FROM k)
        SELECT user_id, round(-ln(greatest([p0, p1, p2, p3][b + 1], 1e-12)), 6) + 0 AS nll, round({_CRPS}, 6) + 0 AS crps, round({_KL}, 6) + 0 AS kl FROM p, q""",
)
def pmf_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's law over the quarters of a day, scored at one of them and held against all users' law."""
    quarter = F.floor(F.hour("ts") / 6)
    law = F.array(*(F.count_if(quarter == j) / F.count("*") for j in range(4)))
    events = table(spark, sf, "events")
    own = events.groupBy("user_id").agg(law.alias("p")).withColumn("bin", F.pmod("user_id", F.lit(4)).cast("int"))
    both = own.join(F.broadcast(events.agg(law.alias("q"))))  # one row
    widths = F.array(*(F.lit(float(j + 1)) for j in range(4)))
    return both.select(
        "user_id", r6(B.pmf_nll(F.col("p"), F.col("bin"))).alias("nll"), r6(B.pmf_crps(F.col("p"), F.col("bin"), widths)).alias("crps"),
        r6(B.pmf_kl(F.col("p"), F.col("q"))).alias("kl"),
    )


@query(
    "price_scales",
    """WITH x AS (SELECT p_partkey, p_retailprice::DOUBLE AS price, p_size * 20.0::DOUBLE AS base, p_retailprice::DOUBLE - 1000 AS x FROM part)
       SELECT p_partkey, round(sign(x) * ln(1 + abs(x)), 6) AS scaled, round(x, 4) AS back, floor(10000 / price)::BIGINT AS shares,
              round((price - base) / base * 100, 4) AS off FROM x""",
)
def price_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric logs and back, whole shares of a budget, differences in per cent."""
    price = F.col("p_retailprice").cast("double")
    scaled = P.symlog(price - 1000)
    return table(spark, sf, "part").select(
        "p_partkey", r6(scaled).alias("scaled"), F.round(P.symexp(scaled), 4).alias("back"),
        P.whole_shares(F.lit(10_000.0), price).alias("shares"), F.round(P.percent_diff(price, F.col("p_size") * 20.0), 4).alias("off"),
    )


@query("report_files", "SELECT DISTINCT p_brand AS name, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS file FROM part")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.withColumn("file", R.file_name(F.col("name")))


@query(
    "identity_history",
    f"""WITH {USER_DAYS}, r AS (SELECT symbol, ts_ms, round(abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms))), 6) AS severity FROM days),
             b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY severity DESC, ts_ms DESC) AS k FROM r WHERE severity > 1),
             i AS (SELECT user_id::VARCHAR AS symbol, epoch_ms(ts) AS at_ms, min(event_type) AS identity FROM events GROUP BY 1, 2),
             n AS (SELECT b.symbol, b.ts_ms, i.at_ms, i.identity FROM b JOIN i USING (symbol) WHERE k <= 16 AND abs(at_ms - ts_ms) <= {20 * DAY}),
             s AS (SELECT symbol, ts_ms, arg_max(identity, at_ms) FILTER (at_ms < ts_ms) AS x, arg_min(identity, at_ms) FILTER (at_ms >= ts_ms) AS y FROM n GROUP BY 1, 2),
             cut AS (SELECT symbol, max(ts_ms) AS c FROM s WHERE x <> y GROUP BY 1)
        SELECT d.symbol, d.ts_ms, d.close FROM days d LEFT JOIN cut USING (symbol) WHERE c IS NULL OR ts_ms >= c""",
)
def identity_history(spark: SparkSession, sf: str) -> DataFrame:
    """Users' days from the newest large move on at which the kind of their events changed."""
    days = bars(spark, sf, DAY, "user_id")
    moves = days.withColumn("severity", r6(F.abs(Q.log_return()))).where("severity > 1").select("symbol", "ts_ms", "severity")
    at = epoch_ms(F.col("ts")).alias("at_ms")
    known = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("symbol"), at).agg(F.min("event_type").alias("identity"))
    return U.identity_cut(days, moves, known).select("symbol", "ts_ms", "close")


@query(
    "split_like_moves",
    f"""WITH {USER_DAYS}, r AS (SELECT symbol, ts_ms, close, ln(close / lag(close) OVER w) AS r, ln(lead(close) OVER w / close) AS later FROM days
                 WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
             x AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ts_ms) AS earlier FROM r),
             m AS (SELECT symbol, ts_ms, r FROM x WHERE abs(r) > 0.4 AND NOT coalesce(abs(r + later) < 0.5 * abs(r), false)
                 AND NOT coalesce(abs(later) > 0.4, false) AND NOT coalesce(abs(earlier) > 0.4, false)),
             q AS (SELECT p.p, q.q FROM (SELECT unnest(range(1, 51)) AS p) p, (SELECT unnest(range(1, 11)) AS q) q WHERE gcd(p.p, q.q) = 1 AND p.p <> q.q),
             o AS (SELECT symbol, ts_ms, p, q, abs(-r - ln(p::DOUBLE / q)) AS off FROM m, q)
        SELECT symbol, ts_ms, arg_min(p, off)::INTEGER AS p, arg_min(q, off)::INTEGER AS q FROM o GROUP BY 1, 2 HAVING min(off) <= 0.02""",
)
def split_like_moves(spark: SparkSession, sf: str) -> DataFrame:
    return A.split_like(bars(spark, sf, DAY, "user_id")).select("symbol", "ts_ms", F.col("ratio.p").alias("p"), F.col("ratio.q").alias("q"))


@query(
    "common_symbols",
    """WITH s AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey::VARCHAR AS symbol FROM orders)
       SELECT symbol FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT y) FROM s)""",
)
def common_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders in every year."""
    slices = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_custkey").cast("string").alias("symbol")).distinct()
    return V.common_symbols(slices, "y")


@query(
    "rollout_report",
    """WITH runs AS (
           SELECT l_suppkey, avg(l_discount) AS r, avg(l_tax * 10) AS a, avg((l_tax * 10 NOT BETWEEN 0.01 AND 0.99)::INTEGER) AS b,
                  arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) / arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS w, count(*) AS n
           FROM lineitem GROUP BY 1)
       SELECT round(sum(r * n) / sum(n), 6) AS reward, round(sum(a * n) / sum(n), 6) AS action, round(sum(b * n) / sum(n), 6) AS at_bounds,
              round(avg(w), 6) AS wealth_ratio FROM runs""",
)
def rollout_report(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' lines as runs, in order of line and price, since a line's number can repeat within an order."""
    steps = table(spark, sf, "lineitem").select(
        "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("step"), F.col("l_discount").alias("reward"),
        (F.col("l_tax") * 10).alias("action"), F.col("l_extendedprice").alias("wealth"),
    )
    found = V.rollout(steps, "l_suppkey", "step")
    return found.select(*(r6(c).alias(c) for c in found.columns))


@query(
    "fitted_support",
    """WITH c AS (SELECT l_quantity::DOUBLE AS x, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS mass FROM c),
            h AS (SELECT *, row_number() OVER (ORDER BY (x <> 25)::INTEGER, mass DESC, x) AS k FROM s WHERE x = 25 OR mass >= 0.005),
            a AS (SELECT * FROM h WHERE k <= 8),
            r AS (SELECT *, sum(n) OVER (ORDER BY x) / sum(n) OVER () AS share FROM s WHERE x NOT IN (SELECT x FROM a)),
            e AS (SELECT floor(share * 19) AS slot, min(x) AS place, sum(mass) AS mass FROM r WHERE share BETWEEN 0.0001 AND 0.9999 GROUP BY 1)
       SELECT 'atom' AS kind, x AS place, round(mass, 6) AS mass FROM a UNION ALL SELECT 'edge', place, round(mass, 6) FROM e""",
)
def fitted_support(spark: SparkSession, sf: str) -> DataFrame:
    found = B.fit_support(table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity").cast("double")), "x", (25.0,), 20)
    return found.select("kind", F.col("at").alias("place"), r6("mass").alias("mass"))


def _clock_sql(y: str) -> str:
    """The offset of New York's midnight in hours: the clock changes at two in the morning, so the day of a change is still as before."""
    sunday = lambda m, d: f"make_date({y}, {m}, {d}) + ((7 - isodow(make_date({y}, {m}, {d}))) % 7)::INTEGER"
    return f"""CASE WHEN {y} >= 2007 THEN CASE WHEN day > {sunday(3, 8)} AND day <= {sunday(11, 1)} THEN 4 ELSE 5 END
                    ELSE CASE WHEN day > {sunday(4, 1)} AND day <= {sunday(10, 25)} THEN 4 ELSE 5 END END"""


@query(
    "grouped_daily",
    f"""WITH sent AS (
            SELECT event_type AS symbol, (ts::DATE - INTERVAL 8 YEAR - INTERVAL 200 DAY)::DATE AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
                   last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2
            UNION ALL SELECT o_orderpriority, o_orderdate::DATE, min(o_totalprice), max(o_totalprice), min(o_totalprice), max(o_totalprice), count(*)::DOUBLE FROM orders GROUP BY 1, 2)
        SELECT symbol, (epoch_ms(day::TIMESTAMP) + ({_clock_sql("year(day)")}) * 3600000)::BIGINT AS ts_ms, open, high, low, close, volume FROM sent""",
)
def grouped_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Days of orders and of events (moved back some years), stamped at New York's midnight."""
    at, day = F.struct("ts", "event_id"), F.to_date("ts")
    shifted = F.date_sub(F.add_months(day, -96), 200)
    events = table(spark, sf, "events").groupBy(F.col("event_type").alias("T"), shifted.alias("day")).agg(
        F.min_by("value", at).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", at).alias("c"), F.count("*").cast("double").alias("v")
    )
    low, high = F.min("o_totalprice"), F.max("o_totalprice")
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("T"), F.to_date("o_orderdate").alias("day")).agg(
        low.alias("o"), high.alias("h"), low.alias("l"), high.alias("c"), F.count("*").cast("double").alias("v")
    )
    return providers.grouped_daily(events.unionByName(orders))


@query(
    "score_documents",
    f"""WITH {BARS}, r AS (SELECT symbol, ts_ms // {DAY} AS day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS r FROM bars)
        SELECT symbol, day, count(r) AS bars, round(avg(r * r), 9) AS score FROM r GROUP BY 1, 2""",
)
def score_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of each symbol's days, written as documents with a version and read again."""
    own = bars(spark, sf).select("symbol", F.floor(F.col("ts_ms") / DAY).alias("day"), M.log_return().alias("r"))
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    R.write_scores(own.groupBy("symbol", "day").agg(F.count("r").alias("bars"), F.round(F.avg(F.col("r") * F.col("r")), 9).alias("score")), path)
    return R.read_scores(spark, path, "symbol string, day long, bars long, score double")


@query(
    "newest_run",
    """WITH runs AS (SELECT o_custkey AS name, max(o_orderdate)::DATE AS touched, max(o_totalprice) = (SELECT max(o_totalprice) FROM orders) AS latest,
                            count(*) FILTER (o_orderstatus = 'F') AS generations FROM orders GROUP BY 1)
       SELECT name::VARCHAR AS name, generations FROM runs WHERE generations > 0 ORDER BY latest DESC, touched DESC, name::VARCHAR DESC LIMIT 1""",
)
def newest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as runs: the one with the dearest order is marked latest, finished orders are generations."""
    orders = table(spark, sf, "orders")
    dearest = orders.agg(F.max("o_totalprice").alias("_top"))  # one row
    runs = orders.join(F.broadcast(dearest)).groupBy(F.col("o_custkey").cast("string").alias("name")).agg(
        F.max("o_orderdate").alias("touched"), F.max(F.col("o_totalprice") == F.col("_top")).alias("latest"), F.count_if(F.col("o_orderstatus") == "F").alias("generations")
    )
    return R.newest_with_data(runs).select("name", "generations")
