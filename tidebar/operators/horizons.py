"""Longer horizons: correlations of sums over runs without gaps, and laws of sums of independent steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.shared import value_counts, written
from tidebar.operators.panel import pairwise_correlation

HORIZONS = (1, 3, 6, 12, 39, 78)


def common_names(panel: DataFrame) -> DataFrame:
    """The rows of names that are there at every instant of the panel."""
    n = panel.agg(F.count_distinct("t").alias("_n"))
    whole = panel.groupBy("symbol").agg(F.count_distinct("t").alias("_c")).join(F.broadcast(n)).where("_c = _n")  # one row
    return panel.join(whole.select("symbol"), "symbol", "left_semi")


def runs(instants: DataFrame, stride_ms: int) -> DataFrame:
    """(ts_ms, run, place, length): runs of instants one stride apart, and each one's place from 0.

    An instant's rank times the stride taken from its time is the same all along a run, so no window spans all instants.
    """
    ranked = value_counts(instants.select("ts_ms").distinct(), "ts_ms")
    ranked = ranked.select("ts_ms", (F.col("ts_ms") - F.col("below") * stride_ms).alias("run"))
    spans = ranked.groupBy("run").agg(F.min("ts_ms").alias("_first"), F.count("*").alias("length"))
    place = ((F.col("ts_ms") - F.col("_first")) / stride_ms).cast("long")
    return ranked.join(spans, "run").select("ts_ms", "run", place.alias("place"), "length")


def horizon_correlation(panel: DataFrame, value: str, stride_ms: int, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(horizon, blocks, names, mean_correlation) of sums over k instants in a row that don't overlap, for each k.

    Only names in every slice take part.  A run gives as many blocks as fit, from its start.  Under two blocks, or two
    names that move, there is no correlation; a horizon without a block has no row.
    """
    own = written(common_names(panel).select("ts_ms", "symbol", F.col(value).alias("_x")), "common")
    at = runs(own, stride_ms)
    each = own.join(at, "ts_ms").select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    block = F.floor(F.col("place") / F.col("horizon"))
    each = each.withColumn("_block", block).where(F.col("_block") < F.floor(F.col("length") / F.col("horizon")))
    sums = each.groupBy("horizon", "run", "_block", "symbol").agg(F.sum("_x").alias("_x"))
    sums = written(sums.select("horizon", F.struct("run", "_block").alias("t"), "symbol", "_x"), "blocks")
    blocks = sums.groupBy("horizon").agg(F.count_distinct("t").alias("blocks"))
    found = pairwise_correlation(sums, "_x", ["horizon"])
    return blocks.join(found, "horizon", "left").select(
        "horizon", "blocks", F.coalesce("names", F.lit(0)).cast("long").alias("names"), F.when(F.col("blocks") >= 2, F.col("mean_correlation")).alias("mean_correlation")
    )


def monthly_correlation(panel: DataFrame, value: str) -> DataFrame:
    """(month, names, mean_correlation) inside each calendar month (UTC), of the names in every slice of the panel."""
    at = F.timestamp_millis("ts_ms")
    own = common_names(panel).withColumn("month", (F.year(at) * 12 + F.month(at) - 1).cast("long"))
    months = own.groupBy("month").agg(F.count_distinct("t").alias("_n")).where("_n >= 2").select("month")
    return pairwise_correlation(own.join(F.broadcast(months), "month"), value, ["month"])


def convolved(law: np.ndarray, k: int) -> np.ndarray:
    """The law of the sum of ``k`` independent steps on one grid, by powers of two; rounding is taken out of its mass."""
    out, power = np.ones(1), law
    while k:
        if k & 1:
            out = np.convolve(out, power)
        power, k = np.convolve(power, power), k >> 1
    return out / out.sum()


def horizon_laws(laws: DataFrame, k: int) -> DataFrame:
    """``laws`` (key, first, step, pmf: masses at first + i * step) to the law of the sum of ``k`` steps: (key, first, step, pmf).

    A pmf of n places becomes one of k * (n - 1) + 1 with the same total mass of 1; null, empty or massless laws give an
    empty one.  A row is a law, so a task's memory is one batch of laws.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pmfs = []
            for pmf in frame["pmf"]:
                own = np.asarray(pmf if pmf is not None else [], float)
                total = own.sum()
                pmfs.append(convolved(own / total, k) if len(own) and total > 0 and k > 0 else np.zeros(0))
            yield frame.assign(first=frame["first"] * k, pmf=pmfs)

    key = laws.schema["key"].dataType.simpleString()
    return laws.select("key", "first", "step", "pmf").mapInPandas(run, f"key {key}, first double, step double, pmf array<double>")
