"""Statistics of forecasts: ranks, AUC, confusion, deciles, selective trading, block bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.shared import percentiles, value_counts, written


def mid_ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds 1-based ranks over all rows, ties at their mean; rows without a value have none."""
    ranks = value_counts(df, column).select(column, (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, column, "left")


def information(df: DataFrame, mu: str = "mu", r: str = "r") -> DataFrame:
    """Pooled Pearson and Spearman correlation."""
    ranked = mid_ranked(mid_ranked(df, mu, "_a"), r, "_b")
    return ranked.agg(F.corr(mu, r).alias("pearson"), F.corr("_a", "_b").alias("spearman"), F.count("*").alias("n"))


def within(df: DataFrame, key: str, mu: str = "mu", r: str = "r") -> DataFrame:
    """Correlation inside each key, and how the keys spread."""
    own = df.groupBy(key).agg(F.corr(mu, r).alias("_c"), F.count("*").alias("_n")).where("_n >= 2 AND _c IS NOT NULL AND NOT isnan(_c)")
    return own.agg(
        F.count("*").alias("keys"), F.median("_c").alias("median_ic"), F.avg("_c").alias("mean_ic"), F.avg((F.col("_c") > 0).cast("double")).alias("share_positive")
    )


def standardised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """z-scores inside each key (deviation of the population); keys of one row or no spread are dropped."""
    w = W.partitionBy(key)
    for c in columns:
        df = df.withColumn(f"z_{c}", F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)))
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(f"z_{c}").isNotNull()
    return df.where(keep)


def confusion(df: DataFrame, mu: str = "mu", r: str = "r") -> DataFrame:
    """Signs of forecasts against signs of outcomes; zeros are counted apart and in none of the four."""
    m, o = F.signum(mu), F.signum(r)
    both = (m != 0) & (o != 0)
    count = lambda c: F.count_if(c)
    tp, fp = count(both & (m > 0) & (o > 0)), count(both & (m > 0) & (o < 0))
    fn, tn = count(both & (m < 0) & (o > 0)), count(both & (m < 0) & (o < 0))
    n = tp + fp + fn + tn
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    edge = F.avg(F.when(m != 0, m * F.col(r))) * 10_000
    return df.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), count(m == 0).alias("undirected"), count(o == 0).alias("flat"),
        share(tp + tn, n).alias("accuracy"), ((share(tp, tp + fn) + share(tn, tn + fp)) / 2).alias("balanced"),
        share(tp, tp + fp).alias("precision"), share(tp + fn, n).alias("base_rate"),
        F.greatest(share(tp + fn, n), share(fp + tn, n)).alias("majority"), edge.alias("edge_bps"),
    )


def auc(df: DataFrame, mu: str = "mu", r: str = "r") -> DataFrame:
    """0.5 + mean placement of rises - mean placement of falls, of directed and moving bars."""
    own = mid_ranked(df.where((F.col(mu) != 0) & (F.col(r) != 0)), mu, "_rank")
    rises, falls = F.avg(F.when(F.col(r) > 0, F.col("_rank"))), F.avg(F.when(F.col(r) < 0, F.col("_rank")))
    return own.agg((0.5 + F.try_divide(rises - falls, F.count("*"))).alias("auc"))


def cutpoints(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """One row with the interior percentiles, by linear interpolation."""
    return percentiles(df, column, [j / k for j in range(1, k)])


def bucketed(df: DataFrame, column: str, cuts: DataFrame, out: str = "decile") -> DataFrame:
    """The number of cutpoints strictly below the value."""
    below = F.size(F.filter("cuts", lambda c: c < F.col(column)))
    return df.join(F.broadcast(cuts)).withColumn(out, below).drop("cuts")


def selective(df: DataFrame, key: str, order: str, thresholds: int = 10, mu: str = "mu", r: str = "r") -> DataFrame:
    """Trading sign(mu) only from decile k on, for every k: trades, turnover with the closing leg, edge, break-even."""
    at = W.partitionBy("k", key).orderBy(order)
    steps = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))))
    steps = steps.withColumn("_pos", F.when(F.col("decile") >= F.col("k"), F.signum(mu)).otherwise(0.0))
    change = F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(at), F.lit(0.0)))
    closing = F.when(F.lead("_pos").over(at).isNull(), F.abs("_pos")).otherwise(0.0)
    steps = steps.withColumn("_turn", change + closing).withColumn("_pay", F.col("_pos") * F.col(r))
    held = F.count_if(F.col("_pos") != 0)
    found = steps.groupBy("k").agg(
        held.alias("held"), F.sum("_turn").alias("turnover"), (F.try_divide(F.sum("_pay"), held) * 10_000).alias("edge_bps"),
        (F.try_divide(F.sum("_pay"), F.sum("_turn")) * 10_000).alias("break_even_bps"),
        F.try_divide(F.count_if(F.col("_pay") > 0).cast("double"), held).alias("hit_rate"),
    )
    return found


def picked_blocks(size: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, i, times): how often each draw takes block i, of as many picks as there are blocks (``size``: one row, n).

    A pick is the first 32 bits of an MD5 over seed, draw and pick, so every statistic sees the same draws, in any rerun.
    """
    each = size.select("n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.select("n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pick"))
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "pick").cast("binary")), 1, 8), 16, 10).cast("long")
    return each.groupBy("draw", F.pmod(word, F.col("n")).alias("i")).agg(F.count("*").alias("times"))


def joint_bootstrap(
    df: DataFrame, block: str, group: str, sums: dict[str, Column], stats: dict[str, Column], draws: int = 200, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """(group, stat, point, se, low, high, blocks, draws) of each group and, where ``group`` is null, of all rows together.

    ``sums`` are additive over rows, ``stats`` expressions over their names.  Blocks are resampled with the same picks for
    all groups, so ``<stat>_over_pooled``, a group's over that of all rows on the same draw, has an interval of its own.
    Draws without a finite value are left out; with fewer than half of them finite, or under two blocks, only the point
    stands.  Rows are summed by block and group first; a draw costs as many rows as there are such sums.
    """
    names = list(sums)
    own = df.select(F.col(block).alias("_block"), F.col(group).alias("_group"), *(c.alias(n) for n, c in sums.items()))
    cells = own.groupBy("_block", "_group").agg(*(F.sum(n).alias(n) for n in names))
    pooled = cells.groupBy("_block").agg(F.lit(None).cast(own.schema["_group"].dataType).alias("_group"), *(F.sum(n).alias(n) for n in names))
    cells = cells.where("_group IS NOT NULL").unionByName(pooled)
    places = value_counts(cells.select("_block").distinct(), "_block").select("_block", F.col("below").alias("i"))
    cells = written(cells.join(places, "_block").drop("_block"), "cells")
    size = cells.agg(F.coalesce(F.max("i") + 1, F.lit(0)).alias("n"))
    drawn = cells.join(picked_blocks(size.where("n > 1"), draws, seed), "i")
    drawn = drawn.groupBy("draw", "_group").agg(*(F.sum(F.col(n) * F.col("times")).alias(n) for n in names))
    whole = cells.groupBy(F.lit(-1).alias("draw"), "_group").agg(*(F.sum(n).alias(n) for n in names))
    both = drawn.unionByName(whole).select("draw", "_group", *(c.cast("double").alias(n) for n, c in stats.items()))
    of_all = lambda n: F.max(F.when(F.col("_group").isNull(), F.col(n))).over(W.partitionBy("draw"))
    both = both.withColumns({f"{n}_over_pooled": F.try_divide(F.col(n), of_all(n)) for n in stats})
    kinds = [k for n in stats for k in (n, f"{n}_over_pooled")]
    pairs = F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("x")) for k in kinds))
    each = both.select("draw", "_group", F.explode(pairs).alias("p")).select("draw", "_group", "p.stat", "p.x")
    x = F.when(~F.isnan("x") & (F.abs("x") < float("inf")) & (F.col("draw") >= 0), F.col("x"))
    tail = (1 - level) / 2
    found = each.groupBy("_group", "stat").agg(
        F.max(F.when(F.col("draw") < 0, F.col("x"))).alias("point"), F.stddev_samp(x).alias("se"), F.percentile(x, F.lit(tail)).alias("low"),
        F.percentile(x, F.lit(1 - tail)).alias("high"), F.count(x).alias("draws"),
    )
    enough = (F.col("draws") * 2 >= draws) & (F.col("n") >= 2) & F.col("point").isNotNull()
    found = found.join(F.broadcast(size))  # one row
    return found.select(
        F.col("_group").alias(group), "stat", "point", *(F.when(enough, F.col(c)).alias(c) for c in ("se", "low", "high")),
        F.col("n").alias("blocks"), "draws",
    )


def block_bootstrap(df: DataFrame, block: str, value: str, draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean of a value, deviation and percentile interval from blocks resampled with replacement; null under two blocks."""
    sums = {"s": F.col(value), "c": F.col(value).isNotNull().cast("long")}
    own = df.withColumn("_all", F.lit(None).cast("int"))
    found = joint_bootstrap(own, block, "_all", sums, {"mean": F.try_divide(F.col("s"), F.col("c"))}, draws, seed, level).where("stat = 'mean'")
    enough = F.col("blocks") >= 2
    return found.select("blocks", F.when(enough, F.col("point")).alias("mean"), F.col("se").alias("sd"), "low", "high")
