"""The first factor of a panel, effective rank, prior liquidity, holding schedules, rational ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.shared import value_counts, written
from tidebar.operators.momentum import by


def standardised_rows(panel: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
    """(t, at array<int>, z array<double>): each instant's z-scores by the names' numbers, and the names in that order.

    Names without spread are left out.  What reaches the driver is one name for each number.
    """
    stats = panel.groupBy("symbol").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).where("_s > 0")
    numbered = written(value_counts(stats.select("symbol"), "symbol").select("symbol", F.col("below").cast("int").alias("_at")), "names")
    z = panel.join(stats, "symbol").join(numbered, "symbol")
    z = z.select("t", F.struct(F.col("_at").alias("at"), ((F.col(value) - F.col("_m")) / F.col("_s")).alias("z")).alias("p"))
    rows = z.groupBy("t").agg(F.collect_list("p").alias("p")).select("t", F.col("p.at").alias("at"), F.col("p.z").alias("z"))
    return written(rows, "scores"), [r.symbol for r in numbered.orderBy("_at").collect()]


def applied(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """Z'Zv in one pass: each instant's sum over names of z * v, and with it the names' sums over instants.

    The vector is broadcast, a number a name; a task adds up its instants, and tasks' sums are merged by a grouped shuffle.
    """
    shared, n = rows.sparkSession.sparkContext.broadcast(v), len(v)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = shared.value, np.zeros(n)
        for frame in frames:
            for at, z in zip(frame["at"], frame["z"], strict=True):
                total[at] += z * (z @ own[at])
        there = np.flatnonzero(total)
        yield pd.DataFrame({"at": there.astype(np.int32), "x": total[there]})

    out = np.zeros(n)
    for r in rows.mapInPandas(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r.x
    return out


def first_factor(panel: DataFrame, value: str, rounds: int = 128, settled: float = 1e-12) -> tuple[pd.DataFrame, float]:
    """Loadings (symbol, loading) with a sum not below 0, and the factor's share of the variance.

    Power iteration on z-scores, absent values as 0, until no loading moves by more than ``settled``; the matrix of all
    pairs of names is never formed.
    """
    rows, names = standardised_rows(panel, value)
    if not names:
        return pd.DataFrame({"symbol": [], "loading": []}), float("nan")
    v = np.full(len(names), 1 / np.sqrt(len(names)))
    for _ in range(rounds):
        w = applied(rows, v)
        size = np.linalg.norm(w)
        if not size:
            break
        moved, v = np.abs(w / size - v).max(), w / size
        if moved <= settled:
            break
    v = v if v.sum() >= 0 else -v
    trace = rows.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    return pd.DataFrame({"symbol": names, "loading": v}), float(v @ applied(rows, v) / trace) if trace else float("nan")


def effective_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """trace(C) ** 2 / sum of C ** 2 of the sample covariance of a few columns."""
    cov = lambda a, b: F.covar_samp(a, b)
    trace = sum((cov(a, a) for a in columns[1:]), cov(columns[0], columns[0]))
    squares = sum((F.pow(cov(a, b), 2) for a in columns for b in columns), F.lit(0.0))
    return df.agg(F.try_divide(trace * trace, squares).alias("effective_rank"))


def prior_liquidity(bars: DataFrame, span_start_ms: int, window: int) -> DataFrame:
    """Rank of names by the sum of positive dollars in the ``window`` bars before a span, over the window's length."""
    before = bars.where(F.col("ts_ms") < span_start_ms)
    last = before.withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts_ms")))).where(F.col("_k") <= window)
    dollars = F.greatest(F.coalesce(F.col("vwap"), F.col("close")) * F.col("volume"), F.lit(0.0))
    found = last.groupBy("symbol").agg((F.sum(dollars) / window).alias("adv"))
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("adv"), "symbol")))


def holdings(panel: DataFrame, k: int) -> DataFrame:
    """Every k-th instant: enter at the close before, hold at most k of the name's own bars; the realized log return."""
    own = W.partitionBy("symbol").orderBy("t")
    ahead = own.rowsBetween(0, k - 1)
    reached = F.sum("realized_r").over(ahead)
    found = panel.withColumn("held", F.count("*").over(ahead)).withColumn("hold_r", reached).withColumn("exit_t", F.max("t").over(ahead))
    return found.where(F.col("t") % k == 0)


def simple_rationals(most: int = 50) -> tuple[tuple[float, int, int], ...]:
    """(value, p, q) of split ratios p / q in lowest terms with small terms, 1 not among them."""
    return tuple((p / q, p, q) for q in range(1, 11) for p in range(1, most + 1) if np.gcd(p, q) == 1 and p != q)


def nearest_rational(ratio: Column, most: int = 50) -> Column:
    """The simple ratio that is nearest in log, as struct(off, p, q)."""
    table = F.array(*(F.struct(F.lit(float(np.log(x))).alias("l"), F.lit(p).alias("p"), F.lit(q).alias("q")) for x, p, q in simple_rationals(most)))
    return F.array_min(F.transform(table, lambda x: F.struct(F.abs(F.ln(ratio) - x["l"]).alias("off"), x["p"].alias("p"), x["q"].alias("q"))))


def split_like(bars: DataFrame, jump: float = 0.4, within: float = 0.02) -> DataFrame:
    """Extreme moves near a simple ratio that neither the next bar takes back nor a neighbour shares."""
    r = F.ln(F.col("close") / F.lag("close").over(by()))
    found = bars.withColumn("r", r).withColumn("_next", F.ln(F.lead("close").over(by()) / F.col("close")))
    found = found.withColumn("_before", F.lag("r").over(by()))
    extreme = F.abs("r") > jump
    reverts = F.coalesce(F.abs(F.col("r") + F.col("_next")) < 0.5 * F.abs("r"), F.lit(False))
    alone = ~F.coalesce(F.abs("_next") > jump, F.lit(False)) & ~F.coalesce(F.abs("_before") > jump, F.lit(False))
    hit = nearest_rational(F.exp(-F.col("r")))
    return found.where(extreme & ~reverts & alone).withColumn("ratio", hit).where(F.col("ratio.off") <= within).drop("_next", "_before")


def seam_census(bars: DataFrame, extreme: float, quiet_range: float, quiet_volume: float) -> DataFrame:
    """Bars (symbol, ts_ms, day, r, s, w) that move more than ``extreme``, with what tells a seam from a trade.

    ratio is the simple ratio nearest to exp(r) and off how far, in log; session_open: the bar before is of another day
    (a first bar opens none); quiet: range and volume stay small for such a move; isolated: neither neighbour is extreme;
    reverts: the next bar takes more than half of it back.
    """
    before, later, day = F.lag("r").over(by()), F.lead("r").over(by()), F.lag("day").over(by())
    far = lambda c: F.coalesce(F.abs(c) > extreme, F.lit(False))
    found = bars.withColumns({"_before": before, "_later": later, "_day": day}).where(F.abs("r") > extreme)
    near = nearest_rational(F.exp("r"))
    return found.withColumn("_near", near).select(
        "symbol", "ts_ms", "r", F.col("_near.p").alias("p"), F.col("_near.q").alias("q"), F.col("_near.off").alias("off"),
        F.coalesce(F.col("_day") != F.col("day"), F.lit(False)).alias("session_open"),
        ((F.col("s") < quiet_range * F.abs("r")) & (F.abs("w") < quiet_volume)).alias("quiet"),
        (~far(F.col("_before")) & ~far(F.col("_later"))).alias("isolated"),
        F.coalesce(F.abs(F.col("r") + F.col("_later")) < 0.5 * F.abs("r"), F.lit(False)).alias("reverts"),
    )
