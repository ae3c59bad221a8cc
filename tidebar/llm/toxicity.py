"""Toxicity scores by logistic regression, learned with FTRL-proximal, over hashed word n-grams and skip-grams.

A text's features are its different words, pairs of neighbours and pairs with one word between, hashed to
``2 ** bits`` places.  Each place has its own learning rate; the L1 term keeps most weights at exactly zero, so the
model that goes to the executors is the short list of the others.

Training takes at most ``max_docs`` labelled documents, those with the least hashes of their ids.  They are dealt
over ``shards`` groups of bounded size; in each epoch every group starts from the same state and the changes are
averaged, block by block of coordinates, in Spark; the driver gets one mean of each coordinate that moved.  Same rows,
same model.

Defined cases: a null or empty text has no features and gets the score of the intercept; null labels are not
learned from; of several labels of one document the highest counts; without labels every score is 0.5's intercept,
which is 0.5; rows that repeat a doc_id are scored each, and of their texts the least is learned from; texts of any
length are read whole, in slices of bounded size; an empty table gives an empty result; columns besides ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, slices
from tidebar.llm.encoder import split_texts

_BLOCK = 14  # bits of a coordinate within its block
_MOVED = "at binary, dz binary, dn binary"
_NOT_WORD = re.compile(r"[\W_]+")


class WordHashes(dict):
    """segment -> 64-bit hash of its letters and digits in lower case; 0 where it has none."""

    def __missing__(self, segment: str) -> int:
        word = _NOT_WORD.sub("", segment.lower())
        got = xxhash.xxh3_64_intdigest(word.encode()) | 1 if word else 0
        if len(segment) < 60:
            if len(self) >= 200_000:
                self.clear()
            self[segment] = got
        return got


_WORDS = WordHashes()


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def feature_places(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word, pair and skip pair of all texts, repeats included."""
    codes, at, words = split_texts(texts)
    word = np.array([_WORDS[w] for w in words], np.uint64)[codes] if len(words) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    doc, word = doc[word > 0], word[word > 0]
    docs, places = [doc], [_place(word, bits)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        pair = word[:-gap] * np.uint64(salt) + (word[gap:] ^ (word[gap:] >> np.uint64(31)))
        docs.append(doc[gap:][same])
        places.append(_place(pair[same], bits))
    return np.concatenate(docs), np.concatenate(places)


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal: alpha and beta set the per-coordinate rates, l1 and l2 the regularisation."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        w = shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> None:
        """One pass, in place; the last coordinate is the intercept, which is not regularised."""
        for places, label in rows:
            at = np.append(places, len(z) - 1)
            own_z, own_n = z[at], n[at]
            w = self.weights(own_z, own_n)
            w[-1] = -own_z[-1] * self.alpha / (self.beta + np.sqrt(own_n[-1]))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / self.alpha
            z[at] = own_z + g - sigma * w
            n[at] = own_n + g * g


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, by place, and the intercept."""

    bits: int
    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << self.bits)
        dense[self.places] = self.weights
        doc, place = feature_places(texts, self.bits)
        heavy = dense[place] != 0
        key = np.unique(doc[heavy] << self.bits | place[heavy])
        doc, place = key >> self.bits, key & ((1 << self.bits) - 1)
        total = self.intercept + np.bincount(doc, dense[place], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3_000_000):
            doc, place = feature_places(batch.column("text"), bits)
            key = np.unique(doc << bits | place)
            at = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1))
            values = (key & ((1 << bits) - 1)).astype("<u4")
            lists = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            keep = [batch.column(c) for c in ("doc_id", "nth", "label")]
            yield pa.record_batch([*keep, pa.array(lists, pa.binary())], names=["doc_id", "nth", "label", "places"])

    return run


def _dense(places: int, at: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, places))
    out[0, at], out[1, at] = z, n
    return out[0], out[1]


def _epoch(ftrl: Ftrl, state, places: int, epoch: int):
    """For applyInArrow: one pass over a shard from the shared state; how the coordinates it met have moved."""

    def run(table: pa.Table) -> pa.Table:
        z, n = _dense(places, *state.value)
        z_was, n_was = z.copy(), n.copy()
        table = table.sort_by([("nth", "ascending"), ("doc_id", "ascending")])
        features = [np.frombuffer(p, "<u4").astype(np.int64) for p in table.column("places").to_pylist()]
        data = list(zip(features, table.column("label").to_pylist(), strict=True))
        order = np.random.default_rng(epoch).permutation(len(data)).tolist()
        ftrl.learn(z, n, [data[k] for k in order])
        at = np.flatnonzero((z != z_was) | (n != n_was))
        moved = (at.astype("<i4"), (z - z_was)[at].astype("<f4"), (n - n_was)[at].astype("<f4"))
        block, begin = np.unique(at >> _BLOCK, return_index=True)
        ends = np.append(begin, len(at)).tolist()
        parts = {k: pa.array([v[a:b].tobytes() for a, b in pairwise(ends)], pa.binary()) for k, v in zip(("at", "dz", "dn"), moved, strict=True)}
        shard = table.column("shard")[: 1].to_pylist() * len(block)
        return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array(block, pa.int32()), **parts})

    return run


def _mean(shards: int):
    """For applyInArrow by block: the mean change of each of its coordinates over all shards, moved there or not."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        at, dz, dn = (
            np.concatenate([np.frombuffer(x, kind) for x in table.column(k).to_pylist()])
            for k, kind in (("at", "<i4"), ("dz", "<f4"), ("dn", "<f4"))
        )
        place, which = np.unique(at, return_inverse=True)
        means = [(np.bincount(which, x) / shards).astype("<f4") for x in (dz, dn)]
        return pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("at", "dz", "dn"), (place, *means), strict=True)})

    return run


def train(
    docs: DataFrame, labels: DataFrame, label: str, bits: int = 20, max_docs: int = 24_000, shard_docs: int = 6_000,
    visits: int = 60_000, ftrl: Ftrl | None = None,
) -> Model:
    """Learns from ``labels`` (doc_id and the 0/1 column ``label``); only a bounded number of rows is gathered.

    Shards have about ``shard_docs`` rows; there are 4 epochs, and more (16 at most) where rows are so few that
    they would be visited less than ``visits`` times.  Every feature is learned, however rare; the L1 term alone
    decides.  Only coordinates that moved travel, as 32-bit numbers.
    """
    spark, ftrl = docs.sparkSession, ftrl or Ftrl()
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.withColumn("nth", F.xxhash64("doc_id")).orderBy("nth", "doc_id").limit(max_docs)
    count = chosen.count()
    shards, epochs = max(1, round(count / shard_docs)), min(16, max(4, -(-visits // max(count, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_docs rows of three numbers, so the texts need not be exchanged
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "nth", "label").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_features(bits), "doc_id long, nth long, label int, places binary")
    # in buckets, so an epoch exchanges no features
    found = found.withColumn("shard", F.pmod("nth", F.lit(shards)).cast("int"))
    dealt = Scratch(spark, "toxicity").put_bucketed(found, "features", "shard", 2 * shards)
    used = max(1, dealt.select("shard").distinct().count())
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for epoch in range(epochs):
        met = np.flatnonzero((z != 0) | (n != 0))
        state = spark.sparkContext.broadcast((met.astype("<i4"), z[met].astype("<f4"), n[met].astype("<f4")))
        work = _epoch(ftrl, state, len(z), epoch)
        moved = dealt.groupBy("shard").applyInArrow(work, f"shard int, block int, {_MOVED}")
        for at, dz, dn in moved.groupBy("block").applyInArrow(_mean(used), _MOVED).collect():
            at = np.frombuffer(at, "<i4")
            z[at] += np.frombuffer(dz, "<f4")
            n[at] += np.frombuffer(dn, "<f4")
        state.destroy()  # its copies on disk go, too
    w = ftrl.weights(z[:-1], n[:-1])
    places = np.flatnonzero(w)
    return Model(bits, places, w[places], float(-z[-1] * ftrl.alpha / (ftrl.beta + np.sqrt(n[-1]))))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3_000_000):
            scores = pa.array(model.value.scores(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), scores], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, score, predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(_scored(shared), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; nothing is exchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=3_000_000):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Whether a row's label is kept from training: by the CRC-32 of the doc_id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
