"""Ranked lexical search of all documents for a table of items, exact, by a threshold-seeded join.

1. Each whole text is cut into terms once.  A bitmap of fixed size, over hashes of the items' terms, keeps the terms that
   items may ask for; the forward index, one row a document with those terms and their counts, is written.
2. Over that index every task gathers, for each term, how many documents have it and its ``k`` highest impacts; merged
   they give document frequencies, highest impacts and the stored lists of ``k``.
3. An item's threshold is seeded from the stored lists: a document's listed impacts add up to no more than its score, and
   the k-th of these sums is a lower bound of the item's k-th score (at least each term's k-th impact).
4. Items meet all documents in blocks of bounded size, broadcast one after another.  An item's terms are ordered by their
   bound, the weight times the highest impact; terms whose sum of bounds up to their own is below the threshold can't
   bring a document into the list alone or together and generate no candidates.  Candidates are rescored exactly over all
   terms.  A task's own k-th score so far raises the threshold further.  Each task gives out k rows an item at most.

Only rows of step 2 and of step 4's end are exchanged: a few for each task and term, or item.

Defined cases: null, empty and term-less texts have no terms and count in no statistic; items without terms, or whose
terms no document has, have no rows.  Rows are documents, so rows that repeat a doc_id or a text are ranked each; of equal
scores the least doc_id comes first, a null doc_id last.  Each row of the items is an item, so an item_id that repeats
gets a list for each row.  Only doc_id, text and item_id, text are read.  Empty tables give an empty one.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, prefix_sums, slices

BITS = 1 << 24
BUCKET = 4096 * 8
#: Bounds of a block of items: entries (terms of items), and the least charge of an item, so that 256 items fill one.
BLOCK, CHARGE = 16_384, 64
#: Terms whose figures a task holds before it gives them out.
HELD = 200_000


def _plain() -> bytes:
    """A byte's place in a term: digits, letters in lower case and bytes of other code points; all else a blank."""
    out = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or chr(c).isalnum():
            out[c] = c + 32 if 65 <= c <= 90 else c
    return bytes(out)


PLAIN = _plain()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by in a document of ``n`` terms, in exact integers."""
    if len(n) and (75 * n_docs * int(n.max()) >= 1 << 63 or 1_000_000_000 * int(tf.max()) >= 1 << 63):
        tf, n = tf.astype(object), n.astype(object)
    m = 25 + 75 * n * n_docs // n_terms
    return (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.int64)


def counted(df: DataFrame, key: str, bits: bytes | None = None) -> DataFrame:
    """(key, n, terms, tfs): all terms of each text with repeats, and those in ``bits`` with their counts."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            sizes, at, names, tfs = [], [0], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = terms_of(text or b"")
                sizes.append(len(found))
                for term, tf in Counter(found).items():
                    place = zlib.crc32(term) % BITS
                    if own is None or own[place >> 3] >> (place & 7) & 1:
                        names.append(term)
                        tfs.append(tf)
                at.append(len(names))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (pa.array(names, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()))]
            yield pa.record_batch([batch.column("key"), pa.array(sizes, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(count, "key long, n long, terms array<string>, tfs array<long>")
    return found.withColumnRenamed("key", key)


def term_bits(terms: DataFrame) -> bytes:
    """A bitmap of the hashes of ``term``: 2 MB, whatever the number of terms; a bit too many only costs a posting."""
    place = F.crc32(F.col("term").cast("binary")) % BITS + 1
    own = terms.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = bytearray(BITS // 8)
    for r in own.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        begin = (r.bucket - 1) * (BUCKET // 8)
        out[begin : begin + BUCKET // 8] = r.bits
    return bytes(out)


def _postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of each posting: its row in the batch, its term, its impact."""
    lists = batch.column("terms")
    rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    tfs = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy(zero_copy_only=False)[rows]
    return rows, lists.flatten(), impacts(tfs, n, n_docs, n_terms)


def highest(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values of each group, groups in ascending order, values in descending order."""
    order = np.lexsort((-value, group))
    own = group[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[nth < k]


def term_figures(index: DataFrame, n_docs: int, n_terms: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (term, row, impact): how many documents have each term, and its k highest impacts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def given() -> pa.RecordBatch:
            cols = [list(held), [x[0] for x in held.values()], [[p[1] for p in x[1]] for x in held.values()], [[p[0] for p in x[1]] for x in held.values()]]
            types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["term", "df", "rows", "impacts"])

        for batch in batches:
            at, terms, impact = _postings(batch, n_docs, n_terms)
            if not len(at):
                continue
            coded = terms.dictionary_encode()
            names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            counts = np.bincount(ids, minlength=len(names)).tolist()
            tops: list[list] = [[] for _ in names]
            best = highest(ids, impact, k)
            where = batch.column("row").to_numpy()[at[best]].tolist()
            for t, i, row in zip(ids[best].tolist(), impact[best].tolist(), where, strict=True):
                tops[t].append((i, row))
            for name, df, top in zip(names, counts, tops, strict=True):
                last = held.get(name)
                held[name] = [df, top] if last is None else [last[0] + df, sorted(last[1] + top, reverse=True)[:k]]
            if len(held) > HELD:
                yield given()
        yield given()

    parts = scratch.put(index.mapInArrow(gather, "term string, df long, rows array<long>, impacts array<long>"), "figures")
    dfs = parts.groupBy("term").agg(F.sum("df").alias("df"))
    each = parts.select("term", F.explode(F.arrays_zip("rows", "impacts")).alias("p")).select("term", F.col("p.rows").alias("row"), F.col("p.impacts").alias("impact"))
    nth = F.row_number().over(W.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return dfs, each.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


@dataclass
class Block:
    """Items of a block: terms by name; by term and item the weight (times repeats) and the sum of bounds up to the term."""

    terms: pa.Array
    items: list[int]
    weights: np.ndarray
    upto: np.ndarray
    threshold: np.ndarray


def block_of(rows: list) -> Block:
    """From (item, term, w, bound, threshold)."""
    items, names = sorted({r.item for r in rows}), sorted({r.term for r in rows})
    place, column = {t: k for k, t in enumerate(names)}, {q: k for k, q in enumerate(items)}
    weights, upto = np.zeros((len(names), len(items)), np.int64), np.full((len(names), len(items)), -1, np.int64)
    threshold, sums = np.zeros(len(items), np.int64), [0] * len(items)
    for r in sorted(rows, key=lambda r: r.bound):
        t, q = place[r.term], column[r.item]
        sums[q] += r.bound
        weights[t, q], upto[t, q], threshold[q] = r.w, sums[q], r.threshold
    return Block(pa.array(names, pa.string()), items, weights, upto, threshold)


def ranked(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each of the block's items."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        least = np.maximum(own.threshold, 1)
        best: list[list] = [[] for _ in own.items]
        for batch in batches:
            at, terms, impact = _postings(batch, n_docs, n_terms)
            found = pc.fill_null(pc.index_in(terms, own.terms), -1).to_numpy(zero_copy_only=False)
            there = found >= 0
            at, found, impact = at[there], found[there], impact[there]
            essential = own.upto >= least
            begins = np.searchsorted(at, np.arange(batch.num_rows + 1)).tolist()
            ids = batch.column("doc_id").to_pylist()
            for row, doc_id in enumerate(ids):
                a, b = begins[row], begins[row + 1]
                mine = found[a:b]
                candidates = np.flatnonzero(essential[mine].any(0))
                if not len(candidates):
                    continue
                scores = impact[a:b] @ own.weights[mine[:, None], candidates]
                enough = np.flatnonzero(scores >= least[candidates])
                for q, score in zip(candidates[enough].tolist(), scores[enough].tolist(), strict=True):
                    top = best[q]
                    bisect.insort(top, (-score, doc_id is None, doc_id or 0))
                    if len(top) >= k:
                        del top[k:]
                        least[q] = max(least[q], -top[-1][0])
        rows = [(own.items[q], None if none else doc_id, -score) for q, top in enumerate(best) for score, none, doc_id in top]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest scores above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    asked = scratch.put(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    wanted = counted(asked, "item").select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    wanted = scratch.put(wanted.select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")), "wanted")
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = _forward(numbered, term_bits(wanted), scratch)
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    dfs, tops = term_figures(index, n_docs, n_terms, k, scratch)
    weights = {"df": F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")}
    highest_of = tops.groupBy("term").agg(F.max("impact").alias("most"))
    known = wanted.join(dfs.withColumns({"w": weights["df"]}), "term").join(highest_of, "term")
    known = scratch.put(known.select("item", "term", (F.col("w") * F.col("times")).alias("w"), (F.col("w") * F.col("times") * F.col("most")).alias("bound")), "known")
    seeds = known.join(tops, "term").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("sum"))
    kth = F.row_number().over(W.partitionBy("item").orderBy(F.desc("sum"), "row"))
    seeds = seeds.withColumn("_nth", kth).where(F.col("_nth") == k).select("item", F.col("sum").alias("threshold"))
    charges = known.groupBy("item").agg(F.greatest(F.count("*"), F.lit(CHARGE)).alias("charge"))
    dealt = prefix_sums(charges, [F.col("item")], "charge", "before", scratch).join(seeds, "item", "left")
    dealt = dealt.select("item", F.floor(F.col("before") / BLOCK).cast("long").alias("block"), F.coalesce("threshold", F.lit(0)).alias("threshold"))
    entries = scratch.put(known.join(dealt, "item"), "entries")
    schema = "item long, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(scratch.path("found/block=-1"))
    for r in entries.select("block").distinct().orderBy("block").collect():
        block = block_of(entries.where(F.col("block") == r.block).collect())
        ranked(index, block, n_docs, n_terms, k).write.parquet(scratch.path(f"found/block={r.block}"))
    found = spark.read.schema(f"{schema}, block long").parquet(scratch.path("found"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _forward(docs: DataFrame, bits: bytes, scratch: Scratch) -> DataFrame:
    """(doc_id, n, terms, tfs, row): the forward index, its rows numbered once, as they are written."""
    found = counted(docs, "doc_id", bits)
    return scratch.put(found.withColumn("row", F.monotonically_increasing_id()), "index")
