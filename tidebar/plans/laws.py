"""Special functions and fitted mixtures over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions import special as S
from tidebar.functions.shared import written
from tidebar.operators import mixtures as X
from tidebar.operators import momentum as M
from tidebar.operators import support as B
from tidebar.plans import query
from tidebar.plans.indicators import BARS, r6
from tidebar.plans.markets import dofs
from tidebar.sources.views import bars, table

_EULER = 0.5772156649015329
_ERF = "exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(90), lambda k: z * pow(z * z, k) / list_product(list_transform(range(0, k + 1), lambda i: (2 * i + 1)::DOUBLE))))"


@query(
    "special_functions",
    f"""WITH own AS (SELECT l_linenumber, l_quantity::DOUBLE AS q, l_linenumber::INTEGER AS a, l_quantity::DOUBLE / 5 AS x, (l_discount::DOUBLE - 0.05) / 0.02 AS z FROM lineitem),
             each AS (SELECT l_linenumber, lgamma(q) AS lg,
                             list_sum(list_transform(range(1, q::INTEGER), lambda k: 1.0::DOUBLE / k)) AS h,
                             exp(-x) * list_sum(list_transform(range(a), lambda k: pow(x, k) / gamma(k + 1))) AS upper,
                             0.5 + {_ERF} AS cdf FROM own)
        SELECT l_linenumber, round(avg(lg), 6) AS ln_gamma, round(avg(coalesce(h, 0) - {_EULER}), 6) AS digamma,
               round(avg(1 - upper), 6) AS gamma_p, round(avg(cdf), 6) AS normal_cdf FROM each GROUP BY 1""",
)
def special_functions(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem")
    q, a, z = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), (F.col("l_discount").cast("double") - 0.05) / 0.02
    each = own.select("l_linenumber", S.column(S.ln_gamma, q).alias("lg"), S.column(S.digamma, q).alias("dg"), S.column(S.gamma_p, a, q / 5).alias("gp"), S.column(S.normal_cdf, z).alias("cdf"))
    return each.groupBy("l_linenumber").agg(r6(F.avg("lg")).alias("ln_gamma"), r6(F.avg("dg")).alias("digamma"), r6(F.avg("gp")).alias("gamma_p"), r6(F.avg("cdf")).alias("normal_cdf"))


@query(
    "normal_pit",
    f"""WITH {BARS}, r AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS r FROM bars),
             s AS (SELECT symbol, greatest(least((r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0), 6), -6) AS z FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol)),
             p AS (SELECT symbol, 0.5 + {_ERF} AS cdf FROM s WHERE z IS NOT NULL)
        SELECT symbol, count(*) AS n, round(avg(cdf), 6) AS mean, round(sum(power(cdf - 0.5, 2)) / count(*), 6) AS spread FROM p GROUP BY 1""",
)
def normal_pit(spark: SparkSession, sf: str) -> DataFrame:
    """Where each return falls in the normal law of its symbol's mean and deviation: mean 1/2 and spread 1/12 if it is one."""
    own = bars(spark, sf).withColumn("r", M.log_return()).where("r IS NOT NULL")
    laws = own.groupBy("symbol").agg(F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s")).where("_s > 0")
    z = F.greatest(F.least((F.col("r") - F.col("_m")) / F.col("_s"), F.lit(6.0)), F.lit(-6.0))
    each = own.join(laws, "symbol").select("symbol", S.column(S.normal_cdf, z).alias("cdf"))
    return each.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.avg("cdf")).alias("mean"), r6(F.avg(F.pow(F.col("cdf") - 0.5, 2))).alias("spread"))


def _em_sql(rounds: int) -> str:
    sql = f"""WITH {BARS}, obs AS MATERIALIZED (
        SELECT r AS x FROM (SELECT ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms)) AS r FROM bars) WHERE r IS NOT NULL
    ), law0 AS MATERIALIZED (
        SELECT 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, quantile_cont(x, 0.25) AS m0, quantile_cont(x, 0.75) AS m1,
               greatest(abs(quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 2, 1e-9) AS s0, s0 AS s1, NULL::DOUBLE AS level FROM obs
    )"""
    for k in range(rounds):
        term = lambda c: f"ln(w{c}) - ln(s{c}) - 0.5 * ln(2 * pi()) - 0.5 * power((x - m{c}) / s{c}, 2)"
        sql += f""", e{k} AS (
        SELECT x, t0, t1, greatest(t0, t1) + ln(exp(t0 - greatest(t0, t1)) + exp(t1 - greatest(t0, t1))) AS ll FROM (SELECT x, {term(0)} AS t0, {term(1)} AS t1 FROM obs, law{k})
    ), a{k} AS (
        SELECT count(*) AS n, avg(ll) AS level, sum(exp(t0 - ll)) AS a0, sum(exp(t1 - ll)) AS a1, sum(exp(t0 - ll) * x) AS b0, sum(exp(t1 - ll) * x) AS b1,
               sum(exp(t0 - ll) * x * x) AS c0, sum(exp(t1 - ll) * x * x) AS c1 FROM e{k}
    ), law{k + 1} AS MATERIALIZED (
        SELECT a0 / n AS w0, a1 / n AS w1, b0 / a0 AS m0, b1 / a1 AS m1, greatest(sqrt(greatest(c0 / a0 - power(b0 / a0, 2), 0)), 1e-9) AS s0,
               greatest(sqrt(greatest(c1 / a1 - power(b1 / a1, 2), 0)), 1e-9) AS s1, level FROM a{k}
    )"""
    return sql + f""" SELECT 0 AS component, round(w0, 6) AS weight, round(m0, 6) AS mean, round(s0, 6) AS sd, round(level, 6) AS level FROM law{rounds}
        UNION ALL SELECT 1, round(w1, 6), round(m1, 6), round(s1, 6), round(level, 6) FROM law{rounds}"""


EM_ROUNDS = 8


@query("gaussian_mixture", _em_sql(EM_ROUNDS))
def gaussian_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Two normal laws fitted to all log returns in a fixed number of rounds."""
    own = bars(spark, sf).select(M.log_return().alias("x"))
    law, path = X.fit(own, "x", X.Gaussian.start(own, "x", 2), EM_ROUNDS, settled=0.0)
    rows = [(c, *map(float, r), path[-1]) for c, r in enumerate(law.rows())] if law else []
    out = spark.createDataFrame(rows, "component int, weight double, mean double, sd double, level double")
    return out.select("component", *(r6(c).alias(c) for c in ("weight", "mean", "sd", "level")))


@query("beta_mixture")
def beta_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Three Beta laws fitted to where closes fall between low and high."""
    own = bars(spark, sf).where("high > low").select(((F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).alias("x"))
    law, path = X.fit(own, "x", X.Beta.start(own, "x", 3), rounds=24)
    rows = [(c, *map(float, r), path[-1]) for c, r in enumerate(law.rows())] if law else []
    return spark.createDataFrame(rows, "component int, weight double, alpha double, beta double, level double")


@query("support_bins")
def support_bins(spark: SparkSession, sf: str) -> DataFrame:
    """128 bins of where closes fall between low and high, with atoms at 0, 1/2 and 1, and the bars in each."""
    own = written(dofs(spark, sf).select(F.col("u").cast("float").cast("double").alias("u")), "places")
    found = B.support_bins(own, "u", (0.0, 0.5, 1.0))
    bins = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found)], "bin int, low double, high double")
    listed = F.broadcast(bins.agg(F.array_sort(F.collect_list(F.struct("low", "high", "bin"))).alias("bins")))  # one row of 128 bins
    # an atom has no width and comes before the bin that begins with it
    here = F.filter("bins", lambda b: F.when(b["low"] == b["high"], b["low"] == F.col("u")).otherwise(b["low"] <= F.col("u")))
    exact = F.filter(here, lambda b: b["low"] == b["high"])
    name = F.when(F.size(exact) > 0, F.get(exact, F.lit(0))).otherwise(F.coalesce(F.get(here, F.size(here) - 1), F.get("bins", F.lit(0))))["bin"]
    counted = own.join(listed).groupBy(name.alias("bin")).agg(F.count("*").alias("bars"))
    return bins.join(counted, "bin", "left").select("bin", r6("low").alias("low"), r6("high").alias("high"), F.coalesce("bars", F.lit(0)).cast("long").alias("bars"))
