"""Codes of vectors by product quantisation in integers: one codebook for each part of a vector, learnt by Lloyd's rounds.

A component x is the integer floor(scale * x), so sums, distances and means are exact and every run agrees.  Codebooks are
broadcast; a task computes the distances of a batch's parts to all entries by expanding the norm, as int64 matrix
products, and takes the first least.  It adds up its parts' sums and counts for each entry, and these sums, one row a
task, part and entry, are merged by a grouped shuffle.  Only codebooks, of ``entries`` vectors, reach the driver.

Defined cases: vectors that are null or hold a null or a component that isn't finite are dropped.  The dimension is that
of the kept vector with the least vec_id; a vector of another dimension, or with a component whose squared distances
could leave 64 bits, keeps its row with a null code and error and takes part in nothing else.  A dimension that ``parts``
doesn't divide is filled up with zeros at the end.  Vectors of no components have code 0 in each part.  Of equal vec_ids
the lesser vector comes first, null vec_ids come last; rows that repeat are coded each.  With fewer vectors than
``entries`` a codebook is as small.  Labels may be null: null is a label of its own.  Only vec_id, embedding and label are
read.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, join_counted

BATCH = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64, parts by entries by components of a part; ``dim``: components of a vector before filling up."""

    entries: np.ndarray
    dim: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def largest(dim: int) -> int:
    """Components up to this leave all sums of squared differences over ``dim`` components, and norms, in 64 bits."""
    return int(((1 << 62) // (4 * max(dim, 1))) ** 0.5)


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the vector ``v`` in integers, null where a component isn't below 2 ** 62."""
    x = lambda c: F.floor(c.cast("double") * scale)
    fits = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < float(1 << 62))
    kept = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("dim"),
        F.when(fits, F.transform("embedding", x)).cast("array<long>").alias("v"),
    )


def first_entries(ints: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The first vectors by vec_id, cut into parts; None where there are none."""
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v")
    dims = first.select("dim").limit(1).collect()
    if not dims:
        return None
    dim = dims[0].dim
    rows = first.where(fitting(dim)).select("v").limit(entries).collect()
    return Codebooks(_parts(np.array([r.v for r in rows], np.int64).reshape(len(rows), dim), parts), dim)


def fitting(dim: int) -> Column:
    most = largest(dim)
    return (F.col("dim") == dim) & F.coalesce(F.forall("v", lambda c: c.between(-most, most)), F.lit(False))


def _parts(v: np.ndarray, parts: int) -> np.ndarray:
    """parts by rows by components, filled up with zeros."""
    width = -(-v.shape[1] // parts)
    filled = np.zeros((len(v), parts * width), np.int64)
    filled[:, : v.shape[1]] = v
    return np.ascontiguousarray(filled.reshape(len(v), parts, width).transpose(1, 0, 2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the first nearest entry and its squared distance, in exact integers."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for begin in range(0, whole.num_rows, BATCH):
            batch = whole.slice(begin, BATCH)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            yield batch, _parts(flat.reshape(batch.num_rows, dim), parts)


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of its parts' mean; entries without parts stay."""
    shape, spark = books.entries.shape, rows.sparkSession
    shared = spark.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for _, cut in _blocks(batches, own.dim, shape[0]):
            for p in range(shape[0]):
                at, _far = nearest(cut[p], own.entries[p])
                np.add.at(sums[p], at, cut[p])
                counts[p] += np.bincount(at, minlength=shape[1])
        p, e = np.nonzero(counts)
        total = pa.array(list(sums[p, e]), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), total], names=["part", "entry", "n", "total"])

    partial = rows.select("v").mapInArrow(add, "part int, entry int, n long, total array<long>")
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(shape[2])))
    out = books.entries.copy()
    for r in merged.collect():
        out[r.part, r.entry] = [int(total) // r.n for total in r[3:]]
    return Codebooks(out, books.dim)


def learn(ints: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks after so many rounds over all rows of ``ints``."""
    books = first_entries(ints, parts, entries)
    if books is None or not books.entries.size:
        return books
    rows = ints.where(fitting(books.dim))
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (an index for each part) and error (squared distances summed over the parts)."""
    shared, parts = ints.sparkSession.sparkContext.broadcast(books), books.entries.shape[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, cut in _blocks(batches, own.dim, parts):
            found = [nearest(cut[p], own.entries[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], 1).astype(np.int32)
            error = sum(far for _, far in found)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    label = dict(ints.dtypes)["label"]
    fits = fitting(books.dim)
    coded = ints.where(fits).select("vec_id", "label", "v").mapInArrow(assign, f"vec_id long, label {label}, codes array<int>, error long")
    others = ints.where(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(others)


def code_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error, label_error) of each usable vector, and the codebooks; label_error sums a label's errors."""
    scratch = Scratch(vectors.sparkSession, "codes")
    ints = scratch.put(integers(vectors, scale), "ints")
    books = learn(ints, parts, entries, rounds)
    empty = books if books is not None else Codebooks(np.zeros((parts, 0, 0), np.int64), -1)
    coded = scratch.put(encode(ints, empty), "coded")
    keyed = coded.withColumn("_null", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("_null", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    sums = scratch.put(sums, "sums")
    found = join_counted(keyed, sums, ["_null", "_label"], "_n", coded.count())
    return found.select("vec_id", "label", "codes", "error", "label_error"), books
