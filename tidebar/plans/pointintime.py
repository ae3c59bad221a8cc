"""Point-in-time joins, alignment, quality scans and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.operators import joins as J
from tidebar.operators import quality as Q
from tidebar.operators import universe as U
from tidebar.plans import query
from tidebar.plans.indicators import BARS, r6
from tidebar.sources.views import DAY, HOUR, bars, bars_sql, epoch_ms, table

#: Monthly mean order price, out 15 days after the month.
MACRO = """macro AS (
    SELECT date_trunc('month', o_orderdate)::DATE AS period,
           (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 15 DAY)::DATE AS available,
           round(avg(o_totalprice), 4) AS value
    FROM orders GROUP BY 1, 2)"""


def macro(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    months = table(spark, sf, "orders").groupBy(F.trunc(day, "month").alias("period")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return months.select("period", F.date_add(F.add_months("period", 1), 15).alias("available"), "value")


@query(
    "asof_macro",
    f"""WITH {MACRO}, days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
        SELECT day, period, value FROM days ASOF LEFT JOIN macro ON day >= available""",
)
def asof_macro(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return J.asof_days(days, macro(spark, sf), "day", "available")


FUNDAMENTALS = """fundamentals AS (
    SELECT o_custkey, date_trunc('quarter', o_orderdate)::DATE AS fiscal, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY 1, 2)"""


@query(
    "asof_lagged",
    f"""WITH {FUNDAMENTALS}, known AS (SELECT *, (fiscal + INTERVAL 90 DAY)::DATE AS available FROM fundamentals)
        SELECT o_orderkey, o.o_custkey, fiscal, revenue
        FROM orders o ASOF LEFT JOIN known k ON o.o_custkey = k.o_custkey AND o.o_orderdate::DATE >= k.available""",
)
def asof_lagged(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    known = orders_fundamentals(spark, sf).withColumn("available", F.date_add("fiscal", 90))
    return J.asof(orders, known, ["o_custkey"], "day", "available", ["fiscal", "revenue"]).drop("day")


def orders_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    quarter = F.trunc(F.to_date("o_orderdate"), "quarter").alias("fiscal")
    return table(spark, sf, "orders").groupBy("o_custkey", quarter).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query(
    "quarterly_growth",
    f"""WITH {FUNDAMENTALS}, pairs AS (
            SELECT *, lag(revenue) OVER (PARTITION BY o_custkey ORDER BY fiscal) AS p FROM fundamentals)
        SELECT o_custkey, fiscal, round(CASE WHEN abs(p) > 0.001 THEN (revenue - p) / abs(p) END, 6) AS growth FROM pairs""",
)
def quarterly_growth(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("revenue").over(W.partitionBy("o_custkey").orderBy("fiscal"))
    growth = F.when(F.abs(before) > 0.001, (F.col("revenue") - before) / F.abs(before))
    return orders_fundamentals(spark, sf).select("o_custkey", "fiscal", r6(growth).alias("growth"))


@query(
    "prior_year",
    f"""WITH {MACRO} SELECT n.period, n.value, CASE WHEN b.available <= n.available THEN b.value END AS prior_value
        FROM macro n LEFT JOIN macro b ON b.period = n.period - INTERVAL 12 MONTH""",
)
def prior_year(spark: SparkSession, sf: str) -> DataFrame:
    known = macro(spark, sf).withColumn("series", F.lit("price"))
    now = known.withColumn("at", F.col("available")).drop("available")
    return J.prior_period(now, known).select("period", "value", "prior_value")


@query(
    "asof_point",
    f"""WITH {MACRO}, points AS (SELECT unnest([DATE '1996-06-01', DATE '1999-01-31', DATE '2000-12-31']) AS day)
        SELECT day, arg_max(period, available) AS period FROM points, macro WHERE available <= day GROUP BY 1""",
)
def asof_point(spark: SparkSession, sf: str) -> DataFrame:
    at = spark.createDataFrame([("1996-06-01",), ("1999-01-31",), ("2000-12-31",)], "d string").select(F.to_date("d").alias("day"))
    return J.asof_days(at, macro(spark, sf), "day", "available").where("period IS NOT NULL").select("day", "period")


@query(
    "exact_ts_join",
    f"""WITH {BARS}, {bars_sql(2 * HOUR, name="coarse")}, market AS (SELECT ts_ms, count(*) AS ids FROM coarse GROUP BY 1)
        SELECT symbol, ts_ms, coalesce(ids, 0)::BIGINT AS market_id FROM bars LEFT JOIN market USING (ts_ms)""",
)
def exact_ts_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each hourly bar's market state at its very instant, from bars of two hours: 0 where none begins then."""
    market = bars(spark, sf, 2 * HOUR).groupBy("ts_ms").agg(F.count("*").alias("ids"))
    return bars(spark, sf).join(market, "ts_ms", "left").select("symbol", "ts_ms", F.coalesce("ids", F.lit(0)).cast("long").alias("market_id"))


@query(
    "align_common_ts",
    f"""WITH {BARS}, whole AS (SELECT ts_ms FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))
        SELECT symbol, ts_ms, close FROM bars WHERE ts_ms IN (SELECT ts_ms FROM whole)""",
)
def align_common_ts(spark: SparkSession, sf: str) -> DataFrame:
    return J.common_timestamps(bars(spark, sf)).select("symbol", "ts_ms", "close")


MIDDLE = 1_705_276_800_000  # 2024-01-15


@query(
    "live_tail_union",
    f"""WITH {BARS}, corpus AS (SELECT * FROM bars WHERE ts_ms < {MIDDLE}),
             tail AS (SELECT * FROM bars WHERE ts_ms >= {MIDDLE} - {DAY}),
             last AS (SELECT symbol, max(ts_ms) AS latest FROM corpus GROUP BY 1)
        SELECT symbol, ts_ms, close FROM corpus
        UNION ALL SELECT t.symbol, t.ts_ms, t.close FROM tail t LEFT JOIN last l USING (symbol) WHERE l.latest IS NULL OR t.ts_ms > l.latest""",
)
def live_tail_union(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).select("symbol", "ts_ms", "close")
    return J.newer_tail(own.where(F.col("ts_ms") < MIDDLE), own.where(F.col("ts_ms") >= MIDDLE - DAY))


SPLITS = """splits AS (SELECT DISTINCT o_custkey AS symbol, o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query(
    "band_join",
    f"""WITH {SPLITS}, days AS (SELECT DISTINCT o_custkey AS symbol, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority <> '1-URGENT')
        SELECT symbol, day FROM days d WHERE EXISTS (
            SELECT 1 FROM splits s WHERE s.symbol = d.symbol AND abs(datediff('day', s.date, d.day)) <= 3)""",
)
def band_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    splits = orders.where("o_orderpriority = '1-URGENT'").select("symbol", "date").distinct()
    days = orders.where("o_orderpriority <> '1-URGENT'").select("symbol", F.col("date").alias("day")).distinct()
    return J.near(days, splits, ["symbol"], "day", "date", 3)


@query(
    "priority_coalesce",
    """WITH ranked AS (
           SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey,
                  min(o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM orders)
       SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority AS provider FROM ranked WHERE o_orderpriority = best""",
)
def priority_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of each customer's first provider that has any."""
    orders = table(spark, sf, "orders")
    best = orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("provider"))
    found = orders.join(best, (orders["o_custkey"] == best["o_custkey"]) & (orders["o_orderpriority"] == best["provider"]), "left_semi")
    return found.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("provider"))


@query(
    "reference_precedence",
    """WITH listings AS (
           SELECT s_name AS name, s_nationkey AS nation, 1 AS priority FROM supplier
           UNION ALL SELECT s_name, s_nationkey + 100, 0 FROM supplier)
       SELECT name, arg_max(nation, priority)::INTEGER AS nation, count(*) AS listings FROM listings GROUP BY 1""",
)
def reference_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Delisted entries, then listed ones over them."""
    own = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    listed = own.select("name", "nation", F.lit(1).alias("priority"))
    gone = own.select("name", (F.col("nation") + 100).alias("nation"), F.lit(0).alias("priority"))
    return gone.unionByName(listed).groupBy("name").agg(
        F.max_by("nation", "priority").cast("int").alias("nation"), F.count("*").alias("listings")
    )


@query(
    "dedup_first",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, (epoch_ms(ts) // 3600000)""",
)
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and hour."""
    hour = F.floor(epoch_ms(F.col("ts")) / HOUR)
    own = table(spark, sf, "events").withColumn("hour", hour)
    return J.first_by(own, ["user_id", "hour"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("dedup_last", """SELECT user_id, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").groupBy("user_id")
    return own.agg(F.max("event_id").alias("event_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("distinct_clock", f"WITH {BARS} SELECT DISTINCT ts_ms FROM bars")
def distinct_clock(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ts_ms").distinct()


@query(
    "ticker_parts",
    """WITH s AS (SELECT DISTINCT user_id::VARCHAR AS symbol FROM events), k AS (SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1) % 6 AS k FROM s)
       SELECT symbol, CASE WHEN k < 4 THEN 'train' WHEN k = 4 THEN 'val' ELSE 'test' END AS part FROM k""",
)
def ticker_parts(spark: SparkSession, sf: str) -> DataFrame:
    return U.ticker_parts(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol")).distinct())


# --- quality

USER_DAYS = bars_sql(DAY, "user_id")


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, DAY, "user_id")


MARKED = f"""{USER_DAYS}, base AS (
    SELECT *, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS r, ts_ms - lag(ts_ms) OVER w AS gap_ms,
           ln(lead(close) OVER w / close) AS later
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)
), marked AS (
    SELECT *, coalesce(gap_ms >= 5 * {DAY}, false) AS hole,
           CASE WHEN abs(r) > 2 * ln(2) AND gap_ms >= 5 * {DAY} THEN 'splice'
                WHEN abs(r) > 2 * ln(2) AND coalesce(abs(r + later) < 0.5 * abs(r), false) THEN 'tick'
                WHEN abs(r) > 2 * ln(2) THEN 'jump' END AS kind
    FROM base)"""
CENSUS = f"""{MARKED}, census AS (
    SELECT symbol, count(*) AS bars, count(*) FILTER (hole) AS holes, count(*) FILTER (kind = 'splice') AS splices,
           count(*) FILTER (kind = 'tick') AS ticks, count(*) FILTER (kind = 'jump') AS jumps,
           count(*) FILTER (ln(high / low) > 2 * ln(2)) AS extreme_range FROM marked GROUP BY 1)"""


@query("anomaly_census", f"WITH {CENSUS} SELECT * FROM census")
def anomaly_census(spark: SparkSession, sf: str) -> DataFrame:
    return Q.census(user_days(spark, sf), hole_days=5)


@query(
    "anomaly_rollup",
    f"""WITH {CENSUS}, rated AS (SELECT symbol, bars, holes + splices + ticks + jumps + extreme_range AS anomalies FROM census)
        SELECT symbol, bars::BIGINT AS bars, anomalies::BIGINT AS anomalies, round(anomalies * 10000.0::DOUBLE / bars, 6) AS per_10k FROM rated
        UNION ALL SELECT NULL, sum(bars)::BIGINT, sum(anomalies)::BIGINT, round(sum(anomalies) * 10000.0::DOUBLE / sum(bars), 6) FROM rated""",
)
def anomaly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rated = Q.rates(Q.census(user_days(spark, sf), hole_days=5))
    found = rated.rollup("symbol").agg(F.sum("bars").alias("bars"), F.sum("anomalies").alias("anomalies"))
    return found.withColumn("per_10k", r6(F.col("anomalies") * 10_000.0 / F.col("bars")))


@query(
    "discontinuities",
    f"""WITH {USER_DAYS}, base AS (
            SELECT *, row_number() OVER w - 1 AS i, ts_ms - lag(ts_ms) OVER w AS gap_ms, close / lag(close) OVER w AS ratio
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))
        SELECT symbol, ts_ms, i, round(gap_ms / {DAY}::DOUBLE + abs(ln(ratio)), 6) AS severity
        FROM base WHERE gap_ms >= 5 * {DAY} OR ratio > 4 OR ratio < 0.25""",
)
def discontinuities(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.discontinuities(user_days(spark, sf))
    return found.select("symbol", "ts_ms", F.col("i").cast("long").alias("i"), r6("severity").alias("severity"))


SEAMS = f"""{MARKED}, legs AS (
    SELECT *, coalesce(lag(kind) OVER (PARTITION BY symbol ORDER BY ts_ms) = 'tick', false) AS leg FROM marked
), user_splits AS (
    SELECT DISTINCT user_id::VARCHAR AS symbol, (ts::DATE) AS date FROM events WHERE event_type = 'signup'
), seams AS (
    SELECT symbol, ts_ms, i, kind FROM legs l WHERE kind IN ('splice', 'jump') AND NOT leg AND NOT EXISTS (
        SELECT 1 FROM user_splits s WHERE s.symbol = l.symbol
        AND abs(datediff('day', s.date, DATE '1970-01-01' + (l.ts_ms // {DAY})::INTEGER)) <= 3))"""


def user_splits(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").where("event_type = 'signup'")
    return own.select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date")).distinct()


def user_seams(spark: SparkSession, sf: str) -> DataFrame:
    return Q.seams(user_days(spark, sf), user_splits(spark, sf), 3)


_NO_HOLES = SEAMS.replace(f"gap_ms >= 5 * {DAY}", f"gap_ms >= 14 * {DAY}")


@query("seam_scan", f"WITH {_NO_HOLES} SELECT symbol, ts_ms, i, kind FROM seams")
def seam_scan(spark: SparkSession, sf: str) -> DataFrame:
    return user_seams(spark, sf).select("symbol", "ts_ms", F.col("i").cast("long").alias("i"), "kind")


@query(
    "truncate_at_seam",
    f"""WITH {_NO_HOLES}, last AS (SELECT symbol, max(ts_ms) AS seam FROM seams GROUP BY 1),
             kept AS (SELECT b.* FROM bars b LEFT JOIN last USING (symbol) WHERE seam IS NULL OR ts_ms >= seam)
        SELECT symbol, ts_ms, close FROM kept WHERE symbol IN (SELECT symbol FROM kept GROUP BY 1 HAVING count(*) >= 5)""",
)
def truncate_at_seam(spark: SparkSession, sf: str) -> DataFrame:
    return Q.after_last_seam(user_days(spark, sf), user_seams(spark, sf), 5).select("symbol", "ts_ms", "close")


# --- universe

SAMPLES = """samples AS (
    SELECT l_suppkey AS symbol, l_shipdate::DATE AS session, sum(l_extendedprice) AS dollar_volume FROM lineitem GROUP BY 1, 2
), refs AS (SELECT s_suppkey AS symbol, s_nationkey < 5 AS delisted FROM supplier)
, upper AS (
    SELECT symbol, count(*) AS sessions, min(session) AS first, max(session) AS last,
           list_sort(list(round(dollar_volume, 4)))[(count(*) // 2)::INTEGER + 1] AS median
    FROM samples WHERE dollar_volume > 0 GROUP BY 1 HAVING count(*) >= 20
), universe AS (
    SELECT symbol, sessions, first, last, median, delisted, row_number() OVER (ORDER BY median DESC, symbol) AS rank
    FROM upper JOIN refs USING (symbol))"""


def universe(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    samples = lines.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session")).agg(
        F.round(F.sum("l_extendedprice"), 4).alias("dollar_volume")
    )
    refs = table(spark, sf, "supplier")
    return U.rank_liquidity(samples, refs.select(F.col("s_suppkey").alias("symbol"), (F.col("s_nationkey") < 5).alias("delisted")), 20)


@query("liquidity_rank", f"WITH {SAMPLES} SELECT symbol, sessions, first, last, round(median, 2) AS median, delisted, rank FROM universe")
def liquidity_rank(spark: SparkSession, sf: str) -> DataFrame:
    found = universe(spark, sf).withColumn("median", F.round("median", 2)).withColumn("rank", F.col("rank").cast("long"))
    return found.select("symbol", "sessions", "first", "last", "median", "delisted", "rank")


FLOORS = (1e4, 2e4, 3e4, 4e4, 5e4, 1e5)


@query(
    "floor_ladder",
    f"""WITH {SAMPLES}, floors AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in FLOORS)}]) AS floor)
        SELECT floor, count(*) FILTER (median >= floor) AS symbols, count(*) FILTER (median >= floor AND delisted) AS delisted
        FROM universe, floors GROUP BY 1""",
)
def floor_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return U.ladder(universe(spark, sf), FLOORS)


@query("eligible_universe", f"WITH {bars_sql(HOUR, 'user_id')} SELECT symbol, count(*) AS bars FROM bars GROUP BY 1 HAVING count(*) >= 60")
def eligible_universe(spark: SparkSession, sf: str) -> DataFrame:
    return U.eligible(bars(spark, sf, HOUR, "user_id"), 60)


@query("deepest_symbols", f"WITH {bars_sql(HOUR, 'user_id')} SELECT symbol, count(*) AS bars FROM bars GROUP BY 1 ORDER BY bars DESC, symbol LIMIT 10")
def deepest_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return U.deepest(bars(spark, sf, HOUR, "user_id"), 10)


BOUNDS = f"""{BARS}, slots AS (SELECT ((ts_ms // {HOUR}) + 1) * {HOUR} AS slot, count(*) AS n FROM bars GROUP BY 1),
    running AS (SELECT slot, sum(n) OVER (ORDER BY slot) AS before, sum(n) OVER () AS total FROM slots),
    bounds AS (SELECT min(slot) FILTER (before >= floor(total * 0.8::DOUBLE + 0.5)) AS b0, min(slot) FILTER (before >= floor(total * 0.9::DOUBLE + 0.5)) AS b1 FROM running)"""


@query("split_bounds", f"WITH {BOUNDS} SELECT b0::BIGINT AS b0, b1::BIGINT AS b1 FROM bounds")
def split_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return U.split_bounds(bars(spark, sf), HOUR)


@query(
    "split_counts",
    f"""WITH {BOUNDS} SELECT symbol, CASE WHEN ts_ms < b0 THEN 'train' WHEN ts_ms < b1 THEN 'val' ELSE 'test' END AS split, count(*) AS bars
        FROM bars, bounds GROUP BY 1, 2""",
)
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    return U.with_split(own, U.split_bounds(own, HOUR)).groupBy("symbol", "split").agg(F.count("*").alias("bars"))


@query(
    "corpus_fingerprint",
    f"""WITH {BOUNDS}, lines AS (SELECT concat_ws(':', symbol, count(*), min(ts_ms), max(ts_ms)) AS line FROM bars GROUP BY symbol)
        SELECT sha256(concat_ws(chr(10), '{HOUR}', any_value(b0)::BIGINT, any_value(b1)::BIGINT, string_agg(line, chr(10) ORDER BY line))) AS fingerprint
        FROM lines, bounds""",
)
def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    return U.fingerprint(own, HOUR, U.split_bounds(own, HOUR))


@query(
    "stride_windows",
    f"""WITH {BARS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
        SELECT symbol, ts_ms, i FROM numbered WHERE i >= 16 AND (i - 16) % 64 = 0 AND i + 64 <= n""",
)
def stride_windows(spark: SparkSession, sf: str) -> DataFrame:
    return U.strided(bars(spark, sf), 16, 64).select("symbol", "ts_ms", F.col("i").cast("long").alias("i"))


@query(
    "block_sample",
    f"""WITH {BARS}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1) // 64 AS block FROM bars),
             keys AS (SELECT symbol, block, row_number() OVER (PARTITION BY symbol ORDER BY sha256(concat_ws(':', 0, symbol, block))) AS nth
                      FROM (SELECT DISTINCT symbol, block FROM numbered))
        SELECT symbol, ts_ms, block FROM numbered JOIN keys USING (symbol, block) WHERE nth <= 3""",
)
def block_sample(spark: SparkSession, sf: str) -> DataFrame:
    return U.block_sample(bars(spark, sf), 64, 3).select("symbol", "ts_ms", "block")


@query(
    "window_quotas",
    f"""WITH {bars_sql(HOUR, 'user_id')}, counts AS (SELECT symbol, count(*) AS capacity FROM bars GROUP BY 1),
             shares AS (SELECT *, capacity * 256.0::DOUBLE / sum(capacity) OVER () AS share FROM counts),
             parts AS (SELECT *, floor(share) AS low, share - floor(share) AS rest FROM shares)
        SELECT symbol, capacity, (low + CASE WHEN row_number() OVER (ORDER BY rest DESC, symbol) <= 256 - sum(low) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM parts""",
)
def window_quotas(spark: SparkSession, sf: str) -> DataFrame:
    counts = bars(spark, sf, HOUR, "user_id").groupBy("symbol").agg(F.count("*").alias("capacity"))
    return U.quotas(counts, 256)


COSTS = """measured AS (
    SELECT l_suppkey AS symbol, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month, avg(l_discount) * 100 AS spread, avg(l_quantity) AS depth
    FROM lineitem GROUP BY 1, 2
), pooled AS (SELECT symbol, avg(spread) AS spread, avg(depth) AS depth FROM measured GROUP BY 1)
, wanted AS (SELECT s_suppkey AS symbol, m AS month FROM supplier, (SELECT unnest([23944, 23950, 23957, 24001]) AS m))"""


@query(
    "fallback_cost",
    f"""WITH {COSTS}, own AS (
            SELECT w.symbol, w.month, arg_min(m.spread, (abs(m.month - w.month), m.month)) FILTER (m.spread > 0) AS spread,
                   arg_min(m.depth, (abs(m.month - w.month), m.month)) FILTER (m.depth > 0) AS depth
            FROM wanted w LEFT JOIN measured m USING (symbol) GROUP BY 1, 2
        ), overall AS (SELECT median(CASE WHEN spread > 0 THEN spread END) AS spread, median(CASE WHEN depth > 0 THEN depth END) AS depth FROM pooled)
        SELECT o.symbol, o.month, round(coalesce(o.spread, CASE WHEN p.spread > 0 THEN p.spread END, a.spread), 6) AS spread,
               round(coalesce(o.depth, CASE WHEN p.depth > 0 THEN p.depth END, a.depth), 6) AS depth,
               CASE WHEN o.spread IS NOT NULL THEN 'month' WHEN p.spread > 0 THEN 'pooled' WHEN a.spread IS NOT NULL THEN 'universe' END AS source
        FROM own o LEFT JOIN pooled p USING (symbol), overall a""",
)
def fallback_cost(spark: SparkSession, sf: str) -> DataFrame:
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("month")
    lines = table(spark, sf, "lineitem")
    measured = lines.groupBy(F.col("l_suppkey").alias("symbol"), month).agg((F.avg("l_discount") * 100).alias("spread"), F.avg("l_quantity").alias("depth"))
    pooled = measured.groupBy("symbol").agg(F.avg("spread").alias("spread"), F.avg("depth").alias("depth")).withColumn("month", F.lit(None).cast("int"))
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.explode(F.array(*map(F.lit, (23944, 23950, 23957, 24001)))).alias("month"))
    found = J.nearest_month(wanted, measured.unionByName(pooled), ["spread", "depth"])
    return found.select("symbol", "month", r6("spread").alias("spread"), r6("depth").alias("depth"), "source")
