"""Comparisons of runs, coverage of windows, endpoints, sleeves, candle paths, observation rows, banded books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.operators.accounts import ledger_legs
from tidebar.operators.momentum import by


def paired(a: DataFrame, b: DataFrame, keys: list[str], score: str, meta: list[str]) -> DataFrame:
    """Differences of two runs' scores by window; refuses runs whose metadata or windows differ."""
    one, two = (x.select(*meta).distinct().limit(2).collect() for x in (a, b))
    if len(one) != 1 or one != two:
        raise ValueError(f"runs are not comparable: {one} and {two}")
    if not a.join(b, keys, "left_anti").isEmpty() or not b.join(a, keys, "left_anti").isEmpty():
        raise ValueError("runs do not have the same windows")
    left, right = a.select(*keys, F.col(score).alias("_a")), b.select(*keys, F.col(score).alias("_b"))
    return left.join(right, keys).select(*keys, (F.col("_a") - F.col("_b")).alias("delta"))


def common_symbols(df: DataFrame, slice_: str) -> DataFrame:
    """Symbols that stand in every slice; one twice in a slice is an error."""
    counts = df.groupBy(slice_, "symbol").agg(F.count("*").alias("_c"))
    if not counts.where("_c > 1").isEmpty():
        raise ValueError("a symbol stands twice in a slice")
    n = df.select(slice_).distinct().agg(F.count("*").alias("_n"))
    own = counts.groupBy("symbol").agg(F.count("*").alias("_k")).join(F.broadcast(n))
    return own.where("_k = _n").select("symbol")


def multiplicity(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, start, end) windows over bar places: bars by how often they are covered, 0 included.

    Starts and ends are events of +1 and -1; a running sum between neighbouring events is the cover of all bars there.
    """
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    ends = windows.select("symbol", F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(windows.select("symbol", F.col("end").alias("at"), F.lit(-1).alias("d")))
    edge = n.select("symbol", F.explode(F.array(F.lit(0).cast("long"), F.col("_n").cast("long"))).alias("at"), F.lit(0).alias("d"))
    events = ends.select("symbol", F.col("at").cast("long").alias("at"), "d").unionByName(edge).groupBy("symbol", "at").agg(F.sum("d").alias("d"))
    w = W.partitionBy("symbol").orderBy("at")
    spans = events.withColumn("covers", F.sum("d").over(w)).withColumn("bars", F.lead("at").over(w) - F.col("at"))
    return spans.where("bars > 0").groupBy("covers").agg(F.sum("bars").cast("long").alias("bars"))


def exceedances(df: DataFrame, column: str, levels: tuple[float, ...]) -> DataFrame:
    """How many absolute values lie above each level."""
    own = df.select(F.abs(column).alias("x"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return own.groupBy("level").agg(F.count_if(F.col("x") > F.col("level")).alias("above"), F.count("x").alias("of"))


def eligible_ranges(bars: DataFrame, split: str, context: int, future: int) -> DataFrame:
    """(symbol, split, start, end) of anchors with a whole context before and future after them in their split."""
    own = bars.withColumn("_i", F.row_number().over(by()) - 1).withColumn("_n", F.count("*").over(W.partitionBy("symbol")))
    spans = own.groupBy("symbol", split).agg(F.min("_i").alias("lo"), (F.max("_i") + 1).alias("hi"), F.max("_n").alias("n"))
    start = F.greatest("lo", F.lit(context)).cast("long")
    end = F.least(F.col("hi"), F.col("n") - future).cast("long")
    return spans.select("symbol", split, start.alias("start"), end.alias("end")).where("start < end")


def endpoints(ranges: DataFrame, quotas: DataFrame) -> DataFrame:
    """``quota`` anchors of each symbol's range, in the middle of as many equal strata."""
    own = ranges.join(quotas, "symbol").where("quota > 0")
    k = own.select("symbol", "start", "end", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
    place = F.col("start") + F.floor((F.col("k") * 2 + 1) * (F.col("end") - F.col("start")) / (2 * F.col("quota")))
    return k.select("symbol", "k", place.cast("long").alias("anchor"))


def rollout(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Means of reward and action, the share of actions at the bounds, and each run's last over first wealth."""
    runs = steps.groupBy(key).agg(
        F.avg("reward").alias("r"), F.avg("action").alias("a"), F.avg((~F.col("action").between(0.01, 0.99)).cast("double")).alias("b"),
        (F.max_by("wealth", order) / F.min_by("wealth", order)).alias("w"), F.count("*").alias("n"),
    )
    weighed = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return runs.agg(weighed("r").alias("reward"), weighed("a").alias("action"), weighed("b").alias("at_bounds"), F.avg("w").alias("wealth_ratio"))


def sleeves(positions: DataFrame, cash: float) -> DataFrame:
    """(symbol, step, price, quantity): each name's sleeve of equal cash, and buying and holding it instead."""
    own = W.partitionBy("symbol").orderBy("step")
    n = positions.select("symbol").distinct().agg(F.count("*").alias("_n"))
    share = cash / F.col("_n")
    spent = F.sum(F.col("_d") * F.col("price")).over(own)
    found = positions.join(F.broadcast(n)).withColumn("_d", F.col("quantity") - F.lag("quantity", 1, 0.0).over(own))
    return found.select(
        "symbol", "step", (share - spent + F.col("quantity") * F.col("price")).alias("sleeve"),
        (share * F.col("price") / F.first("price").over(own)).alias("held"),
    )


def candle_path(dofs: DataFrame, key: list[str], order: str) -> DataFrame:
    """Candles chained from a close of 1 by their coordinates r, s, u, v."""
    own = W.partitionBy(*key).orderBy(order)
    close = F.exp(F.sum("r").over(own.rowsBetween(W.unboundedPreceding, 0)))
    low = F.col("p_close") * F.exp(-F.col("u") * F.col("s"))
    found = dofs.withColumn("p_close", close).withColumn("p_low", low)
    return found.withColumn("p_open", F.col("p_low") * F.exp(F.col("v") * F.col("s"))).withColumn("p_high", F.col("p_low") * F.exp("s"))


def observation(columns: dict[str, Column]) -> Column:
    """The observation row in its order: indicators scaled to about -1..1."""
    scaled = {
        "mom_5": lambda c: c * 2, "mom_60": lambda c: c, "mom_120": lambda c: c / 2, "rsi": lambda c: c * 2 - 1, "zscore": lambda c: c / 3,
        "stoch_k": lambda c: c * 2 - 1, "steps_since_trade": lambda c: 1 / (1 + c / 50),
    }
    return F.array(*(scaled[k](c).cast("float") if k in scaled else c.cast("float") for k, c in columns.items()))


def banded_backtest(panel: DataFrame, weight: str, cost_bps: float, band: float) -> DataFrame:
    """(t, gross_r, turnover, net_r, log_wealth, wealth) of a book that trades a name only when its target is more than ``band`` away.

    Names are streams of their own; leavers are sold and charged at the next instant.  Instants, one row each, are summed
    up in one window.
    """
    own = panel.withColumns({"adv": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double")})
    steps = ledger_legs(own, weight, band).groupBy("t").agg(F.coalesce(F.sum(F.col("held") * F.expm1("realized_r")), F.lit(0.0)).alias("gross_r"), F.sum("trade").alias("turnover"))
    steps = steps.withColumn("net_r", F.col("gross_r") - F.col("turnover") * cost_bps / 10_000)
    log_wealth = F.sum(F.ln(F.greatest(1 + F.col("net_r"), F.lit(1e-12)))).over(W.orderBy("t"))
    return steps.withColumn("log_wealth", log_wealth).withColumn("wealth", F.exp("log_wealth"))
