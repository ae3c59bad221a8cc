"""Further statistics of panels, encodings and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.operators import evaluate as V
from tidebar.operators import factors as A
from tidebar.operators import momentum as M
from tidebar.operators import panel as N
from tidebar.operators import skill as S
from tidebar.operators import universe as U
from tidebar.plans import SQL, query
from tidebar.plans.indicators import BARS, r6
from tidebar.plans.markets import DOF, FORECAST, PANEL, dofs, forecast, panel
from tidebar.plans.pointintime import BOUNDS, MIDDLE
from tidebar.sources.views import DAY, HOUR, bars, table

_PAIRS = [(a, b) for a in "rsuv" for b in "rsuv"]


@query(
    "effective_rank",
    f"""WITH {DOF}, c AS (SELECT {", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in _PAIRS)} FROM dofs)
        SELECT round(power(rr + ss + uu + vv, 2) / ({" + ".join(f"{a}{b} * {a}{b}" for a, b in _PAIRS)}), 6) AS effective_rank FROM c""",
)
def effective_rank(spark: SparkSession, sf: str) -> DataFrame:
    return A.effective_rank(dofs(spark, sf), list("rsuv")).select(r6("effective_rank").alias("effective_rank"))


@query(
    "prior_liquidity",
    f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS k FROM bars WHERE ts_ms < {MIDDLE}),
             s AS (SELECT symbol, round(sum(vwap * volume) / 100, 4) AS adv FROM k WHERE k <= 100 GROUP BY 1)
        SELECT symbol, adv, row_number() OVER (ORDER BY adv DESC, symbol)::INTEGER AS rank FROM s""",
)
def prior_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return A.prior_liquidity(bars(spark, sf), MIDDLE, 100).withColumn("adv", F.round("adv", 4))


@query(
    "holding_schedule",
    f"""WITH {PANEL}, h AS (
            SELECT t, symbol, count(*) OVER w AS held, sum(realized_r) OVER w AS hold_r, max(t) OVER w AS exit_t
            FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
        SELECT t, symbol, held, round(hold_r, 6) AS hold_r, exit_t FROM h WHERE t % 6 = 0""",
)
def holding_schedule(spark: SparkSession, sf: str) -> DataFrame:
    found = A.holdings(panel(spark, sf), 6)
    return found.select(F.col("t").cast("long").alias("t"), "symbol", "held", r6("hold_r").alias("hold_r"), F.col("exit_t").cast("long").alias("exit_t"))


@query(
    "daily_correlation",
    f"""WITH {PANEL}, days AS (SELECT ts_ms // {DAY} AS day, t, symbol, realized_r AS r FROM panel),
             n AS (SELECT day, count(DISTINCT t) AS n FROM days GROUP BY 1),
             s AS (SELECT day, symbol, count(*) AS c, avg(r) AS m, stddev_pop(r) AS sd FROM days GROUP BY 1, 2),
             live AS (SELECT s.* FROM s JOIN n USING (day) WHERE c = n AND sd > 0),
             sums AS (SELECT day, t, sum((r - m) / sd) AS z, count(*) AS k FROM days JOIN live USING (day, symbol) GROUP BY 1, 2)
        SELECT day, max(k) AS names, round(CASE WHEN max(k) >= 2 THEN (avg(z * z) - max(k)) / (max(k) * max(k) - max(k)) END, 6) AS mean_correlation
        FROM sums GROUP BY 1""",
)
def daily_correlation(spark: SparkSession, sf: str) -> DataFrame:
    own = panel(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / DAY))
    return N.pairwise_correlation(own, "realized_r", ["day"]).select("day", "names", r6("mean_correlation").alias("mean_correlation"))


@query(
    "standardised_ic",
    f"""WITH {FORECAST}, z AS (
            SELECT (mu - avg(mu) OVER d) / nullif(stddev_pop(mu) OVER d, 0) AS a, (r - avg(r) OVER d) / nullif(stddev_pop(r) OVER d, 0) AS b
            FROM (SELECT *, t // 24 AS day FROM forecast) WINDOW d AS (PARTITION BY day))
        SELECT round(corr(a, b), 6) AS ic, count(*) AS n FROM z WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def standardised_ic(spark: SparkSession, sf: str) -> DataFrame:
    own = S.standardised(forecast(spark, sf).withColumn("day", F.floor(F.col("t") / 24)), "day", ["mu", "r"])
    return own.agg(r6(F.corr("z_mu", "z_r")).alias("ic"), F.count("*").alias("n"))


@query(
    "nearest_rational",
    """WITH q AS (SELECT p.p, q.q FROM (SELECT unnest(range(1, 51)) AS p) p, (SELECT unnest(range(1, 11)) AS q) q WHERE gcd(p.p, q.q) = 1 AND p.p <> q.q),
            ratios AS (SELECT p_partkey, p_retailprice / (p_size * 20.0::DOUBLE) AS x FROM part),
            off AS (SELECT p_partkey, p, q, abs(ln(x) - ln(p::DOUBLE / q)) AS off FROM ratios, q)
       SELECT p_partkey, arg_min(p, (round(off, 12), p))::INTEGER AS p, arg_min(q, (round(off, 12), p))::INTEGER AS q, round(min(off), 6) AS off FROM off GROUP BY 1""",
)
def nearest_rational(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").withColumn("_r", A.nearest_rational(F.col("p_retailprice") / (F.col("p_size") * 20.0)))
    return own.select("p_partkey", F.col("_r.p").alias("p"), F.col("_r.q").alias("q"), r6("_r.off").alias("off"))


@query(
    "sampled_sessions",
    """WITH span AS (SELECT min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS b FROM orders),
            d AS (SELECT a + floor(i * (b - a) / 36.0::DOUBLE)::INTEGER AS day FROM span, (SELECT unnest(range(37)) AS i))
       SELECT DISTINCT (day - greatest(isodow(day)::INTEGER - 5, 0)) AS day FROM d""",
)
def sampled_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Days spaced evenly over the span of the orders."""
    return U.sampled_sessions(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), 37)


@query(
    "first_factor",
    f"""WITH RECURSIVE {PANEL}, stats AS (SELECT symbol, avg(realized_r) AS m, stddev_pop(realized_r) AS sd FROM panel GROUP BY 1 HAVING stddev_pop(realized_r) > 0),
             z AS MATERIALIZED (SELECT t, symbol, (realized_r - m) / sd AS z FROM panel JOIN stats USING (symbol)),
             cells AS (SELECT a.symbol AS x, b.symbol AS y, sum(coalesce(p.z * q.z, 0)) AS g FROM stats a CROSS JOIN stats b
                       LEFT JOIN z p ON p.symbol = a.symbol LEFT JOIN z q ON q.symbol = b.symbol AND q.t = p.t GROUP BY 1, 2),
             gram AS MATERIALIZED (SELECT list(row ORDER BY x) AS g, list(x ORDER BY x) AS names, count(*) AS n FROM (SELECT x, list(g ORDER BY y) AS row FROM cells GROUP BY 1)),
             it AS (SELECT 0 AS k, list_transform(names, lambda s: 1 / sqrt(n)) AS v FROM gram
                    UNION ALL
                    SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (
                        SELECT k, list_transform(g, lambda row: list_inner_product(row, v)) AS w FROM it, gram WHERE k < 128)),
             last AS (SELECT CASE WHEN list_sum(v) < 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM it WHERE k = 128),
             done AS (SELECT names, v, list_inner_product(v, list_transform(g, lambda row: list_inner_product(row, v))) / (SELECT sum(g) FROM cells WHERE x = y) AS share FROM last, gram)
        SELECT unnest(names) AS symbol, unnest(list_transform(v, lambda x: round(x, 5))) AS loading, round(share, 6) AS share FROM done""",
)
def first_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of the panel's first factor and its share of the variance."""
    loadings, share = A.first_factor(panel(spark, sf), "realized_r")
    out = spark.createDataFrame(loadings.assign(share=share), "symbol string, loading double, share double")
    return out.select("symbol", F.round("loading", 5).alias("loading"), r6("share").alias("share"))


@query(
    "elapsed_gaps",
    f"""WITH {BARS}, g AS (SELECT symbol, (ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms)) // {HOUR} AS gap FROM bars)
        SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2""",
)
def elapsed_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.floor((F.col("ts_ms") - F.lag("ts_ms").over(M.by())) / HOUR)
    return bars(spark, sf).select("symbol", gap.alias("gap")).where("gap IS NOT NULL").groupBy("symbol", "gap").agg(F.count("*").alias("n"))


# --- evaluations

WINDOWS = f"""{BARS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    windows AS (SELECT symbol, i AS start, i + 64 AS stop FROM numbered WHERE i % 40 = 0 AND i + 64 <= n)"""


def covers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = bars(spark, sf).withColumn("i", M.index())
    own = own.withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    return own.where("i % 40 = 0 AND i + 64 <= n").select("symbol", F.col("i").alias("start"), (F.col("i") + 64).alias("end")), own


@query(
    "coverage_multiplicity",
    f"""WITH {WINDOWS}, c AS (SELECT b.symbol, b.i, count(w.start) AS covers FROM numbered b LEFT JOIN windows w ON w.symbol = b.symbol AND b.i >= w.start AND b.i < w.stop GROUP BY 1, 2)
        SELECT covers, count(*) AS bars FROM c GROUP BY 1""",
)
def coverage_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    return V.multiplicity(*covers(spark, sf))


LEVELS = (0.5, 1.0, 2.0, 3.0, 4.0)


@query(
    "exceedances",
    f"""WITH {DOF}, l AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in LEVELS)}]) AS level)
        SELECT level, count(*) FILTER (abs(r) > level) AS above, count(r) AS of FROM dofs, l GROUP BY 1""",
)
def exceedances(spark: SparkSession, sf: str) -> DataFrame:
    return V.exceedances(dofs(spark, sf), "r", LEVELS)


RANGES = f"""{BOUNDS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    parts AS (SELECT symbol, CASE WHEN ts_ms < b0 THEN 'train' WHEN ts_ms < b1 THEN 'val' ELSE 'test' END AS split, i, n FROM numbered, bounds),
    spans AS (SELECT symbol, split, greatest(min(i), 50) AS start, least(max(i) + 1, max(n) - 10) AS "end" FROM parts GROUP BY 1, 2)"""


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf)
    return V.eligible_ranges(U.with_split(own, U.split_bounds(own, HOUR)), "split", 50, 10)


@query("eligible_ranges", f'WITH {RANGES} SELECT * FROM spans WHERE start < "end"')
def eligible_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges(spark, sf)


@query(
    "stratified_endpoints",
    f"""WITH {RANGES}, k AS (SELECT unnest(range(7)) AS k)
        SELECT symbol, k, (start + (2 * k + 1) * ("end" - start) // 14)::BIGINT AS anchor FROM spans, k WHERE "end" > start AND split = 'train'""",
)
def stratified_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    own = ranges(spark, sf).where("split = 'train'")
    return V.endpoints(own, own.select("symbol", F.lit(7).cast("long").alias("quota")))


@query(
    "sleeves",
    f"""WITH {BARS}, p AS (SELECT symbol, row_number() OVER w - 1 AS step, close AS price, (row_number() OVER w - 1) % 3::DOUBLE AS q FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
             d AS (SELECT *, q - lag(q, 1, 0) OVER w AS d FROM p WINDOW w AS (PARTITION BY symbol ORDER BY step))
        SELECT symbol, step, round(10000.0::DOUBLE / (SELECT count(DISTINCT symbol) FROM bars) - sum(d * price) OVER w + q * price, 4) AS sleeve, round(10000.0::DOUBLE / (SELECT count(DISTINCT symbol) FROM bars) * price / first_value(price) OVER w, 4) AS held
        FROM d WINDOW w AS (PARTITION BY symbol ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)
def sleeves(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).select("symbol", M.index().cast("long").alias("step"), F.col("close").alias("price"))
    found = V.sleeves(own.withColumn("quantity", (F.col("step") % 3).cast("double")), 10_000.0)
    return found.select("symbol", "step", F.round("sleeve", 4).alias("sleeve"), F.round("held", 4).alias("held"))


@query(
    "paired_deltas",
    f"""WITH {BARS} SELECT symbol, ts_ms, round((high - low) - abs(close - open), 6) AS delta FROM bars""",
)
def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    own = bars(spark, sf).withColumn("run", F.lit("v1"))
    a = own.select("symbol", "ts_ms", "run", (F.col("high") - F.col("low")).alias("score"))
    b = own.select("symbol", "ts_ms", "run", F.abs(F.col("close") - F.col("open")).alias("score"))
    found = V.paired(a, b, ["symbol", "ts_ms"], "score", ["run"])
    return found.withColumn("delta", r6("delta"))


@query(
    "candle_path",
    f"""WITH {DOF}, days AS (SELECT *, ts_ms // {DAY} AS day FROM dofs),
             c AS (SELECT *, exp(sum(r) OVER (PARTITION BY symbol, day ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)) AS k FROM days)
        SELECT symbol, ts_ms, round(k, 5) AS p_close, round(k * exp(-u * s), 5) AS p_low, round(k * exp(-u * s) * exp(v * s), 5) AS p_open, round(k * exp(-u * s) * exp(s), 5) AS p_high FROM c""",
)
def candle_path(spark: SparkSession, sf: str) -> DataFrame:
    own = V.candle_path(dofs(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / DAY)), ["symbol", "day"], "ts_ms")
    return own.select("symbol", "ts_ms", *(F.round(c, 5).alias(c) for c in ("p_close", "p_low", "p_open", "p_high")))


#: Indicators of an observation, in order: the query that has each, and its scale as SQL.
_OBSERVED = {
    "mom_5": ("momentum_returns", "mom_5 * 2"), "mom_60": ("momentum_returns", "mom_60"), "mom_120": ("momentum_returns", "mom_120 / 2"),
    "mom_accel": ("momentum_acceleration", "mom_accel"), "rsi": ("rsi14", "rsi * 2 - 1"), "trend_strength": ("trend_strength", "trend_strength"),
    "range_pos": ("stoch_range", "range_pos"), "stoch_k": ("stoch_range", "stoch_k * 2 - 1"), "zscore": ("zscore20", "zscore / 3"), "efficiency": ("efficiency20", "efficiency"),
}
_PARTS = dict.fromkeys(q for q, _ in _OBSERVED.values())


@query(
    "observation_rows",
    "SELECT symbol, ts_ms, " + ", ".join(f"round(({x})::FLOAT::DOUBLE, 5) AS o_{n}" for n, (_, x) in _OBSERVED.items())
    + " FROM " + " JOIN ".join(f"({SQL[q]}) AS {q}" + (" USING (symbol, ts_ms)" if k else "") for k, q in enumerate(_PARTS)),
)
def observation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each bar's indicators, to six places, as one row of an agent's observation."""
    own = M.momentum(bars(spark, sf)).select("symbol", "ts_ms", V.observation({k: r6(k) for k in _OBSERVED}).alias("o"))
    return own.select("symbol", "ts_ms", *(F.round(F.get("o", F.lit(k)).cast("double"), 5).alias(f"o_{n}") for k, n in enumerate(_OBSERVED)))
