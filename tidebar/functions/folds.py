"""Recursions along each symbol's time, which windows can't express.

``streamed`` sorts rows within partitions and streams them, with one state in memory: any step, one task a symbol.
``scanned`` is for y[t] = a[t] * y[t - 1] + b[t]: such steps are affine maps, whose composition is associative, so time is
cut into ranges, each range composes its own maps, and only one map a range and symbol is carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidebar.functions.shared import written


def streamed(
    df: DataFrame, keys: list[str], order: list[Column], run: Callable[[tuple, object, pd.DataFrame], tuple], schema: StructType
) -> DataFrame:
    """``run(key, state, rows) -> (state, rows)`` over each key's rows in order, in slices; state starts as None."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            for own, rows in frame.groupby(keys, sort=False, dropna=False):
                if own != key:
                    key, state = own, None
                state, out = run(own, state, rows)
                if out is not None and len(out):
                    yield out

    return dealt.mapInPandas(over, schema)


def recurrence(df: DataFrame, keys: list[str], order: list[Column], out: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for each name, y[t] = a[t] * y[t - 1] + b[t] with y = b at a key's first row; names of columns a, b."""
    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in out)])

    def run(key: tuple, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        last, added = dict(state or {}), {}
        for name, (a, b) in out.items():
            y, ys = last.get(name), []
            for p, q in zip(rows[a].tolist(), rows[b].tolist(), strict=True):
                y = q if y is None else p * y + q
                ys.append(y)
            last[name], added[name] = y, ys
        return last, rows.assign(**added)

    return streamed(df, keys, order, run, schema)


def scanned(df: DataFrame, keys: list[str], order: list[Column], out: dict[str, tuple[str, str]]) -> DataFrame:
    """``recurrence`` by ranges of time: the same values but for rounding, and no task needs a whole symbol.

    A range's rows get B, the recursion from 0, and A, the product of the factors so far; where the ranges before have
    left y, the value is A * y + B.  Keys are never null, and ``order`` is unique in a key.
    """
    names = list(out)
    added = [StructField(f"_run_{x}", DoubleType()) for x in names] + [StructField(x, DoubleType()) for x in names]
    schema = StructType([*df.schema.fields, *added, StructField("_nth", LongType())])

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, nth = None, {}, 0
        for frame in frames:
            for own, rows in frame.groupby(keys, sort=False, dropna=False):
                if own != key:
                    key, state, nth = own, {x: (1.0, 0.0) for x in names}, 0
                products, values = {}, {}
                for x, (a, b) in out.items():
                    factor, y = state[x]
                    products[f"_run_{x}"], values[x] = (grown := []), (ys := [])
                    for p, q in zip(rows[a].tolist(), rows[b].tolist(), strict=True):
                        factor, y = factor * p, p * y + q if y else q
                        grown.append(factor)
                        ys.append(y)
                    state[x] = factor, y
                yield rows.assign(**products, **values, _nth=range(nth, nth + len(rows)))
                nth += len(rows)

    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInPandas(over, schema)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "scan")
    last = [F.max_by(c, "_nth").alias(c) for x in names for c in (f"_run_{x}", x)]
    pieces = ranged.groupBy(*keys, "_range").agg(*last)
    carried = recurrence(pieces, keys, [F.col("_range")], {f"_y_{x}": (f"_run_{x}", x) for x in names})
    before = W.partitionBy(*keys).orderBy("_range")
    carried = carried.select(*keys, "_range", *(F.lag(f"_y_{x}").over(before).alias(f"_y_{x}") for x in names))
    value = {x: F.when(F.col(f"_y_{x}").isNull(), F.col(x)).otherwise(F.col(f"_run_{x}") * F.col(f"_y_{x}") + F.col(x)) for x in names}
    return ranged.join(carried, [*keys, "_range"]).withColumns(value).select(*df.columns, *names)


def ema(df: DataFrame, column: str, alphas: dict[str, float], order: str = "ts_ms", key: str = "symbol") -> DataFrame:
    """Exponential means that start at the first value: alpha weighs the new value."""
    first = F.lag(column).over(_by(key, order)).isNull()
    for name, alpha in alphas.items():
        df = df.withColumn(f"_a_{name}", F.lit(1 - alpha)).withColumn(
            f"_b_{name}", F.when(first, F.col(column)).otherwise(F.col(column) * alpha)
        )
    found = scanned(df, [key], [F.col(order)], {name: (f"_a_{name}", f"_b_{name}") for name in alphas})
    return found.drop(*(f"_{k}_{name}" for name in alphas for k in "ab"))


def _by(key: str, order: str):
    return W.partitionBy(key).orderBy(order)
