"""Cross-sections: panels of names that really printed, weights, correlations, factor, books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.prices import log_ratio
from tidebar.functions.shared import value_counts
from tidebar.operators.momentum import by


def returns(bars: DataFrame) -> DataFrame:
    """(t, ts_ms, symbol, realized_r, close): names whose bar before is that of the instant before on the clock."""
    clock = bars.select("ts_ms").distinct()
    # instants are few next to bars, but are numbered by one window all the same
    clock = clock.select("ts_ms", (F.row_number().over(W.orderBy("ts_ms")) - 1).alias("t"), F.lag("ts_ms").over(W.orderBy("ts_ms")).alias("_tick"))
    own = bars.withColumn("_prev", F.lag("ts_ms").over(by())).withColumn("_close", F.lag("close").over(by())).join(clock, "ts_ms")
    kept = own.where("_prev = _tick AND close > 0 AND _close > 0")
    return kept.select("t", "ts_ms", "symbol", log_ratio(F.col("close"), F.col("_close")).alias("realized_r"), "close")


def book_weights(panel: DataFrame, score: str, gross: float = 1.0) -> DataFrame:
    """Long-only, signed and dollar-neutral weights of each instant, scaled to ``gross``.

    Equal scores hold no neutral book: what is left of them around their mean is rounding alone.
    """
    at = W.partitionBy("t")
    scaled = lambda x: F.coalesce(F.try_divide(x * gross, F.sum(F.abs(x)).over(at)), F.lit(0.0))
    s = F.col(score)
    around = F.when(F.min(s).over(at) < F.max(s).over(at), s - F.avg(s).over(at)).otherwise(0.0)
    centred = panel.withColumn("_long", F.greatest(s, F.lit(0.0))).withColumn("_centred", around)
    return centred.withColumns(
        {"long_only": scaled(F.col("_long")), "signed": scaled(s), "neutral": scaled(F.col("_centred"))}
    ).drop("_long", "_centred")


def pairwise_correlation(panel: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean correlation of all pairs of names present at every instant, without a self-join.

    With z-scores, the mean over time of (sum over names of z) ** 2 is n plus the sum of all correlations.
    """
    keys = keys or []
    n_t = panel.groupBy(*keys).agg(F.countDistinct("t").alias("_t")) if keys else panel.agg(F.countDistinct("t").alias("_t"))
    by_name = panel.groupBy(*keys, "symbol").agg(F.count("*").alias("_c"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    live = by_name.join(n_t, keys) if keys else by_name.join(F.broadcast(n_t))
    live = live.where("_c = _t AND _s > 0").select(*keys, "symbol", "_m", "_s")
    z = panel.join(live, [*keys, "symbol"]).withColumn("_z", (F.col(value) - F.col("_m")) / F.col("_s"))
    per_t = z.groupBy(*keys, "t").agg(F.sum("_z").alias("_z"), F.count("*").alias("_n"))
    n = F.max("_n")
    return per_t.groupBy(*keys).agg(
        n.alias("names"), F.when(n >= 2, (F.avg(F.pow("_z", 2)) - n) / (n * n - n)).alias("mean_correlation")
    )


def panel_backtest(panel: DataFrame, weight: str, cost_bps: float) -> DataFrame:
    """Wealth of a book that trades to its target at every instant, at a flat cost: (t, gross_r, turnover, net_r, wealth).

    A name that leaves is sold and charged at the next instant of the clock.
    """
    own = W.partitionBy("symbol").orderBy("t")
    held = panel.select("t", "symbol", F.col(weight).alias("w"), "realized_r")
    held = held.withColumn("_before", F.lag("t").over(own)).withColumn("_next", F.lead("t").over(own))
    last = held.agg(F.max("t").alias("_end"))
    w_before = F.when(F.col("_before") == F.col("t") - 1, F.lag("w").over(own)).otherwise(0.0)
    held = held.withColumn("_trade", F.abs(F.col("w") - w_before))
    gone = held.where("_next IS NULL OR _next > t + 1").join(F.broadcast(last)).where("t < _end")
    gone = gone.select((F.col("t") + 1).alias("t"), F.lit(0.0).alias("pay"), F.abs("w").alias("trade"))
    legs = held.select("t", (F.col("w") * F.expm1("realized_r")).alias("pay"), F.col("_trade").alias("trade")).unionByName(gone)
    steps = legs.groupBy("t").agg(F.sum("pay").alias("gross_r"), F.sum("trade").alias("turnover"))
    steps = steps.withColumn("net_r", F.col("gross_r") - F.col("turnover") * cost_bps / 10_000)
    wealth = F.exp(F.sum(F.ln(F.greatest(1 + F.col("net_r"), F.lit(1e-12)))).over(W.orderBy("t")))
    return steps.withColumn("wealth", wealth)


def equal_weight_benchmark(bars: DataFrame, cash: float = 10_000.0) -> DataFrame:
    """Equal amounts of every name bought at its second bar's open, marked at closes; ``cash`` at the first step."""
    found = bars.withColumn("step", F.row_number().over(by()) - 1).withColumn("_entry", F.when(F.col("step") == 1, F.col("open")))
    entry = found.where("step = 1").select("symbol", F.col("open").alias("_open"))
    n = entry.agg(F.count("*").alias("_n"))
    held = found.drop("_entry").join(entry, "symbol").join(F.broadcast(n))
    value = F.when(F.col("step") == 0, cash / F.col("_n")).otherwise(cash / F.col("_n") / F.col("_open") * F.col("close"))
    return held.groupBy("step").agg(F.sum(value).alias("value"), F.count("*").alias("names"))


def metrics(equity: DataFrame, key: str, order: str, value: str, start: float = 10_000.0) -> DataFrame:
    """Of each equity curve: return, drawdown (percent), sharpe, sortino, calmar, win rate; deviations of populations."""
    w = W.partitionBy(key).orderBy(order)
    peak = F.greatest(F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(start))
    found = equity.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_fall", (1 - F.col(value) / peak) * 100)
    total = (F.max_by(value, order) / start - 1) * 100
    sd, down = F.stddev_pop("_r"), F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r")))
    return found.groupBy(key).agg(
        F.count("_r").alias("returns"), total.alias("total_return"), F.max("_fall").alias("max_drawdown"),
        F.coalesce(F.when(sd > 0, F.avg("_r") / sd), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.when(down > 0, F.avg("_r") / down), F.lit(0.0)).alias("sortino"),
        F.coalesce(F.try_divide(total, F.max("_fall")), F.lit(0.0)).alias("calmar"),
        F.avg((F.col("_r") > 0).cast("double")).alias("win_rate"),
    )


def nearest_rank_by_rows(df: DataFrame, column: str, qs: dict[str, float]) -> DataFrame:
    """Sorted elements at round((n - 1) * q), halves up, from the counts of the values."""
    counts = value_counts(df, column)
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("_n"))
    own = counts.join(F.broadcast(total))  # one row
    at = lambda q: F.floor((F.col("_n") - 1) * F.lit(q) + 0.5)
    here = lambda q: (F.col("below") <= at(q)) & (at(q) < F.col("below") + F.col("n"))
    return own.agg(*(F.max(F.when(here(q), F.col(column))).alias(name) for name, q in qs.items()))


def kelly(mu: Column, variance: Column, floor: float, most: float) -> Column:
    return F.least(F.greatest(mu / (variance + floor), F.lit(-most)), F.lit(most))
