"""Packed bar files ``<SYMBOL>.<seconds>.bars`` and journals.

A file is a 64-byte header (magic, version, resolution, count, first and last time, 24-byte symbol) and 36-byte
records, little-endian, times strictly increasing.  Files are read through Spark's own file reader, so any store that
Spark opens will do, and parsed in batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.shared import written

# fixed values of the file format
MAGIC, VERSION = b"TBBARS01", 1
HEADER = "<8sIIQqq24s"
HEADER_BYTES = struct.calcsize(HEADER)
RECORD = np.dtype(
    [("ts_ms", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("volume", "<f4"), ("vwap", "<f4"), ("trades", "<u4")]
)

SCHEMA = "symbol string, res_secs int, ts_ms long, open double, high double, low double, close double, volume double, vwap double, trades long"
_VALUES = ("open", "high", "low", "close", "volume", "vwap")


def file_symbol(path: Column) -> Column:
    """The symbol in a file's name, which may have dots; null for other names."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)\.[1-9]\d*\.bars$", 1), F.lit(""))


def file_resolution(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+\.([1-9]\d*)\.bars$", 1).try_cast("int")


def encode(symbol: str, res_secs: int, rows: np.ndarray) -> bytes:
    """A whole file; fails where times do not increase."""
    if len(rows) > 1 and (np.diff(rows["ts_ms"]) <= 0).any():
        raise ValueError(f"times of {symbol} are not strictly increasing")
    first, last = (int(rows["ts_ms"][0]), int(rows["ts_ms"][-1])) if len(rows) else (0, 0)
    return struct.pack(HEADER, MAGIC, VERSION, res_secs, len(rows), first, last, symbol.encode()) + rows.tobytes()


def decode(content: bytes) -> tuple[str, int, np.ndarray]:
    """(symbol, resolution, records); fails on anything that is not a whole, consistent file."""
    if len(content) < HEADER_BYTES:
        raise ValueError("shorter than a header")
    magic, version, res_secs, count, first, last, symbol = struct.unpack_from(HEADER, content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a bar file of this version")
    if len(content) != HEADER_BYTES + RECORD.itemsize * count:
        raise ValueError("length and count disagree")
    rows = np.frombuffer(content, RECORD, offset=HEADER_BYTES)
    if count and (rows["ts_ms"][0] != first or rows["ts_ms"][-1] != last):
        raise ValueError("header and records disagree")
    return symbol.rstrip(b"\0").decode(), res_secs, rows


def _frame(symbol: str, res_secs: int, rows: np.ndarray) -> pd.DataFrame:
    data = {"symbol": symbol, "res_secs": np.int32(res_secs), "ts_ms": rows["ts_ms"].astype(np.int64)}
    data |= {k: rows[k].astype(float) for k in _VALUES}
    return pd.DataFrame(data | {"trades": rows["trades"].astype(np.int64)})


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bars of the files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bars").load(path)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield _frame(*decode(content))

    return files.select("content").mapInPandas(parse, SCHEMA)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Counts and extents, from names and headers alone: symbol, res_secs, bars, first_ts_ms, last_ts_ms."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bars").load(path)
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content in frame["head"]:
                _, _, res, count, first, last, symbol = struct.unpack(HEADER, content)
                out.append((symbol.rstrip(b"\0").decode(), res, count, first, last))
            yield pd.DataFrame(out, columns=["symbol", "res_secs", "bars", "first_ts_ms", "last_ts_ms"])

    heads = files.select(F.substring("content", 1, HEADER_BYTES).alias("head"))
    return heads.mapInPandas(parse, "symbol string, res_secs int, bars long, first_ts_ms long, last_ts_ms long")


def packed(bars: DataFrame, res_secs: int) -> DataFrame:
    """(name, content): a packed file for each symbol, which must be small enough to be one."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ts_ms")
        rows = np.zeros(table.num_rows, RECORD)
        for k in RECORD.names:
            rows[k] = table.column(k).to_numpy()
        symbol = key[0].as_py()
        return pa.table({"name": [f"{symbol}.{res_secs}.bars"], "content": pa.array([encode(symbol, res_secs, rows)], pa.binary())})

    return bars.groupBy("symbol").applyInArrow(pack, "name string, content binary")


def unpacked(files: DataFrame) -> DataFrame:
    """The bars of (name, content) rows."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield _frame(*decode(content))

    return files.select("content").mapInPandas(parse, SCHEMA)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet, partitioned by resolution, sorted by symbol and time; fails on two bars at one time."""
    twice = bars.groupBy("symbol", "res_secs", "ts_ms").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("duplicate timestamps")
    bars.repartition("res_secs", "symbol").sortWithinPartitions("symbol", "ts_ms").write.partitionBy("res_secs").parquet(path)


def append_bars(spark: SparkSession, path: str, bars: DataFrame) -> int:
    """Appends the bars that are later than their symbol's last, and returns how many; a second call appends none."""
    last = spark.read.parquet(path).groupBy("symbol", "res_secs").agg(F.max("ts_ms").alias("_last"))
    newer = bars.join(last, ["symbol", "res_secs"], "left").where("_last IS NULL OR ts_ms > _last").drop("_last")
    newer = written(newer.dropDuplicates(["symbol", "res_secs", "ts_ms"]), "newer")
    n = newer.count()
    if n:
        newer.sortWithinPartitions("symbol", "ts_ms").write.mode("append").partitionBy("res_secs").parquet(path)
    return n


def replay_journal(lines: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """The last whole record of each key from (value, nth) lines of JSON; torn lines are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}
    parsed = lines.select("nth", F.from_json("value", f"{schema}, _torn string", options).alias("r"))
    whole = parsed.where("r._torn IS NULL AND " + " AND ".join(f"r.{k} IS NOT NULL" for k in keys))
    whole = whole.select("nth", "r.*").drop("_torn")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("nth")))
    return whole.withColumn("_k", last).where("_k = 1").drop("_k", "nth")


def covered(entries: DataFrame, fresh_after_ms: int, wanted_from_ms: int) -> DataFrame:
    """Journal entries that need no new fetch: there are bars, the right edge is fresh or the name is gone, and the
    recorded request reaches far enough back."""
    fresh = F.coalesce(F.col("delisted"), F.lit(False)) | (F.col("last_ts_ms") >= fresh_after_ms)
    return entries.where((F.col("bars") > 0) & fresh & (F.col("requested_from_ms") <= wanted_from_ms))
