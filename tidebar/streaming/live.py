"""Live ticks to complete bars: stateful, in order, and failing closed.

``buckets`` folds a symbol's ticks into tumbling buckets and gives out a bucket's last close when the next one
begins, if that is its neighbour: before a gap the last bucket is stale and goes.  A tick for an older bucket, or
without a price, is an error, given out as a row of kind ``late`` or ``invalid`` instead of being dropped.  ``barrier`` lets a bucket through once every symbol has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = "symbol string, bucket long, close double, kind string"
_STATE = "bucket long, close double"


def fold_ticks(state: tuple | None, ticks: list[tuple[int, float]], width_s: int) -> tuple[tuple | None, list[tuple]]:
    """(state, [(bucket, close, kind)]) after ticks (epoch seconds, close) in order of arrival."""
    out = []
    for ts, close in ticks:
        bucket = ts // width_s
        if close is None or not 0 < close < float("inf"):
            out.append((bucket, close, "invalid"))
        elif state is None or bucket == state[0]:
            state = (bucket, close)
        elif bucket < state[0]:
            out.append((bucket, close, "late"))
        else:
            if bucket == state[0] + 1:
                out.append((*state, "bar"))
            state = (bucket, close)
    return state, out


def buckets(ticks: DataFrame, width_s: int = 300) -> DataFrame:
    """Ticks (symbol, seq, ts_s, close) to completed buckets, as a stream, folded in the order of arrival, ``seq``.

    Ticks may have a ``tie`` that orders those of one seq.
    """
    order = ["seq", "tie"] if "tie" in ticks.columns else ["seq"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        now, out = fold_ticks(now, list(zip(rows["ts_s"].tolist(), rows["close"].tolist(), strict=True)), width_s)
        if now is not None:
            state.update(now)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["symbol", "bucket", "close", "kind"])

    return ticks.groupBy("symbol").applyInPandasWithState(run, BUCKETS, _STATE, "append", GroupStateTimeout.NoTimeout)


def barrier(bars: DataFrame, symbols: int) -> DataFrame:
    """Buckets that all symbols have completed, each once: (bucket, closes by symbol)."""
    own = bars.where("kind = 'bar'")
    found = own.groupBy("bucket").agg(F.count_distinct("symbol").alias("_n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "close")))).alias("closes"))
    return found.where(F.col("_n") == symbols).drop("_n")


def last_closes(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """The plain tumbling window: last close of each bucket and symbol; works on streams with a watermark and on tables."""
    at = F.timestamp_seconds("ts_s")
    bucket = F.window(at, width)
    return ticks.groupBy("symbol", bucket.alias("w")).agg(F.max_by("close", "ts_s").alias("close"), F.count("*").alias("ticks")).select(
        "symbol", F.unix_seconds("w.start").alias("bucket_s"), "close", "ticks"
    )


def feed_health(latest: DataFrame, now_s: int, max_age_s: int, max_ahead_s: int = 15) -> DataFrame:
    """(symbol, ts_s, received_s) to ok, stale, silent or ahead, per symbol."""
    found = latest.groupBy("symbol").agg(F.max("ts_s").alias("ts_s"), F.max("received_s").alias("received_s"))
    state = (
        F.when(F.col("ts_s") > now_s + max_ahead_s, "ahead")
        .when(now_s - F.col("received_s") > max_age_s, "silent")
        .when(now_s - F.col("ts_s") > max_age_s, "stale")
        .otherwise("ok")
    )
    return found.withColumn("state", state)
