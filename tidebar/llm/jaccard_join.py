"""Near-duplicate join: MinHash banding finds candidates, full n-gram sets decide.

1. Equal texts are one class, and one row of it goes on.
2. A class's signature is cut into bands; bands and rows a band are chosen so that a pair at the threshold meets in
   one band with the target recall.  Band hashes are exchanged; classes that share one are hung on the least of them,
   and the components of that graph hold every candidate pair.
3. The texts of a component are held against each other by their full sets of word n-grams.  A component of more than
   a block's documents or bytes is cut into blocks along its bands: classes with the same least neighbour stay together
   as far as a block goes.  Each block is a tile, and so are any two blocks in which some band occurs, so every pair
   that shares a band meets in one tile, no task holds more than two blocks, and blocks that share no band never
   meet.  A text goes to as many tiles as blocks share its block's bands.
4. Components of the verified links are the result's classes.

Words are runs between white space, as they are; a text of fewer words than an n-gram has is one n-gram; n-grams are
held by 64-bit hashes.  Defined cases: a null text is an empty one; texts without words have no n-grams and link to
none (equal ones are copies all the same); rows that repeat a doc_id are documents of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, join_counted, slices, text_key, text_or_empty
from tidebar.llm.components import components
from tidebar.llm.encoder import split_texts

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def choose_bands(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which ``recall`` is reached within ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall can't be reached within so many hashes")
    return best


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) < 60:
            if len(self) >= 200_000:
                self.clear()
            self[word] = got
        return got


_WORD_HASH = _WordHash()


def ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts end to end, repeats included, and where each text's begin."""
    codes, at, words = split_texts(texts)
    word = np.array([_WORD_HASH[w] for w in words], np.uint64)[codes] if len(words) else np.empty(0, np.uint64)
    counts = np.diff(at)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(grams)])
    starts = np.repeat(at[:-1] - begin[:-1], grams) + np.arange(begin[-1])
    left = np.repeat(at[1:], grams)
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        inside = starts + k < left
        own = np.where(inside, word[np.minimum(starts + k, max(len(word) - 1, 0))], np.uint64(0)) if len(word) else h
        h = h * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(k + 1) * inside
    return _mixed(h), begin


def _signatures(n: int, bands: int, rows: int):
    """For mapInArrow: a row for each text with its band hashes; a text without n-grams has none."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, begin = ngrams(batch.column("text"), n)
            full = np.diff(begin) > 0
            packed = np.empty((int(full.sum()), bands), np.uint64)
            if len(packed):
                for b in range(bands):
                    key = np.full(len(packed), b + 1, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        least = np.minimum.reduceat(h * factors[r] + shifts[r], begin[:-1][full])
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
                    packed[:, b] = key
            lists = np.full(batch.num_rows, None, object)
            lists[full] = [x.tobytes() for x in packed]
            names = ["doc_id", "text_hash", "n_bytes"]
            yield pa.record_batch([*map(batch.column, names), pa.array(lists, pa.binary())], names=[*names, "bands"])

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, bands = batch.column("node").to_numpy(), batch.column("bands").to_pylist()
        keys = np.frombuffer(b"".join(bands), np.int64)
        each = np.array([len(b) // 8 for b in bands], np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(np.repeat(node, each))], names=["key", "node"])


def overlaps(doc: np.ndarray, gram: np.ndarray, m: int, most_pairs: int = 4_000_000) -> np.ndarray:
    """How many n-grams each two of ``m`` sets share; (doc, gram) has no repeats."""
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    _, begin, uses = np.unique(gram, return_index=True, return_counts=True)
    begin, uses = begin[uses > 1], uses[uses > 1]
    out = np.zeros((m, m), np.int64)
    if not len(uses):
        return out
    if float((uses.astype(float) ** 2).sum()) * 8 > float(m) * m * len(uses) / 16:
        for a in range(0, len(uses), 2048):  # as products of dense blocks of columns
            u, s = uses[a : a + 2048], begin[a : a + 2048]
            block = np.zeros((m, len(u)), np.float32)
            for k in range(int(u.max())):
                on = u > k
                block[doc[s[on] + k], np.flatnonzero(on)] = 1
            out += (block @ block.T).astype(np.int64)
        return out
    for size in np.unique(uses).tolist():  # as lists of pairs
        s = begin[uses == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, most_pairs // len(i))
        for a in range(0, len(s), step):
            x = (doc[s[a : a + step, None] + i] * m + doc[s[a : a + step, None] + j]).ravel()
            out += np.bincount(x, minlength=m * m).reshape(m, m)
    return out + out.T


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    root = np.full(len(links), -1)
    for k in np.flatnonzero(links.any(1)).tolist():
        if root[k] < 0:
            front = np.array([k])
            while len(front):
                root[front] = k
                front = np.flatnonzero(links[front].any(0) & (root < 0))
    return root


def _tile(n: int, threshold: Fraction):
    """For applyInArrow: a tile's texts held against each other; node, links, root for those that have links."""
    num, den = threshold.numerator, threshold.denominator

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        h, begin = ngrams(table.column("text").combine_chunks(), n)
        m = len(node)
        doc = np.repeat(np.arange(m), np.diff(begin))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        size = np.bincount(doc, minlength=m)
        shared = overlaps(doc, h, m)
        links = shared * (num + den) >= num * (size[:, None] + size[None, :])
        links &= (shared > 0) & ~np.eye(m, dtype=bool)
        if one != two:
            block = table.column("block").to_numpy()
            links &= block[:, None] != block[None, :]
        root, degree = _forest(links), links.sum(1)
        some = degree > 0
        return pa.table({"node": node[some], "links": degree[some].astype(np.int64), "root": node[root[some]]})

    return run


def _with_texts(source: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their texts, exchanged by key at any size: how many members there are grows with the documents."""
    own = members.select("text_hash", "rep_id", "node", "root", "block", "one", "two").hint("merge")
    return source.join(own, (source["text_hash"] == own["text_hash"]) & source["doc_id"].eqNullSafe(own["rep_id"]))


def jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_docs: int = 1500,
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_copies, text_key, kept.

    ``class_id`` is the least doc_id of all documents that chains of links join (null where none has one), and
    ``kept`` marks the document of that id, of the least text_key where texts share it; ``n_links`` counts the different
    texts with a similarity of ``threshold`` or more, ``n_copies`` the documents of the same text, itself included.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    exact = Fraction(threshold).limit_denominator(10_000)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", "text", text_key().alias("text_hash"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    work = _signatures(n, *choose_bands(float(exact), recall))
    signed = scratch.put(source.mapInArrow(work, "doc_id long, text_hash binary, n_bytes long, bands binary"), "signed")
    classes = signed.groupBy("text_hash").agg(
        F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"),
        F.first("n_bytes").alias("n_bytes"),
    )
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    bands = classes.where("bands IS NOT NULL").select("node", "bands").mapInArrow(_band_rows, "key long, node long")
    banded = scratch.put(bands, "banded")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("uses")).where("uses > 1")
    hubs, total = scratch.put(hubs, "hubs"), banded.count()
    met = join_counted(banded, hubs, ["key"], "uses", total)
    candidates = scratch.put(
        components(met.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")), scratch, "candidates"), "candidates"
    )

    members = candidates.join(classes.select("node", "text_hash", "rep_id", "n_bytes"), "node")
    sizes = members.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))
    parts = lambda: F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("bytes") / block_bytes)).cast("long")
    sizes = scratch.put(sizes.withColumn("blocks", parts()), "sizes")
    members = scratch.put(join_counted(members, sizes.drop("bytes"), ["root"], "docs", candidates.count()).drop("docs"), "members")
    large = members.where("blocks > 1").select("node", "root", "n_bytes", "blocks")
    if large.isEmpty():
        members = members.withColumns({"one": F.lit(0).cast("long"), "two": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
    else:
        near = met.groupBy("node").agg(F.min("hub").alias("near"))
        near = large.join(near, "node")
        groups = near.groupBy("root", "near").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))
        groups = scratch.put(groups.select("root", "near", "docs", parts().alias("cuts")), "groups")
        near = join_counted(near, groups, ["root", "near"], "docs", candidates.count())
        own = F.xxhash64("near", F.pmod(F.xxhash64("node"), F.col("cuts")))  # of a group of more than a block, a part
        shared = F.pmod(F.xxhash64("near"), F.col("blocks"))
        blocks = scratch.put(near.select("node", "root", F.when(F.col("cuts") > 1, own).otherwise(shared).alias("block")), "blocks")
        places = banded.join(blocks, "node").select("root", "key", "block").distinct()
        lists = places.groupBy("root", "key").agg(F.array_sort(F.collect_set("block")).alias("all"))
        pairs = lists.select("root", "all", F.explode("all").alias("one"))
        pairs = pairs.select("root", "one", F.explode(F.filter("all", lambda x: x >= F.col("one"))).alias("two")).distinct()
        ends = pairs.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
        tiles = ends.groupBy("root", "block").agg(F.collect_list(F.struct("one", "two")).alias("tiles"))
        tiled_blocks = blocks.join(tiles, ["root", "block"]).select("node", "block", F.explode("tiles").alias("tile"))
        tiled_blocks = tiled_blocks.select("node", "block", "tile.one", "tile.two")
        none = {k: F.lit(0).cast("long") for k in ("one", "two", "block")}
        members = members.where("blocks = 1").withColumns(none).unionByName(members.where("blocks > 1").join(tiled_blocks, "node"))
    tiled = _with_texts(source, members).select("root", "one", "two", "block", "node", "text")
    verified = tiled.groupBy("root", "one", "two").applyInArrow(_tile(n, exact), "node long, links long, root long")
    verified = scratch.put(verified, "verified")
    joined = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "links")

    degree = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    placed = classes.select("node", "text_hash", "rep_id", "n_copies").join(joined, "node", "left").join(degree, "node", "left")
    placed = scratch.put(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    first = F.struct(F.isnull("rep_id").alias("no_id"), "rep_id", "text_hash")
    named = placed.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("members"))
    named = scratch.put(named, "named")
    found = join_counted(placed, named, ["root"], "members", placed.count()).select(
        "text_hash", F.col("first.rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_copies", (F.col("text_hash") == F.col("first.text_hash")).alias("is_first"),
    )
    kept = F.col("is_first") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    found = scratch.put(found, "found")
    return join_counted(signed.select("doc_id", "text_hash"), found, ["text_hash"], "n_copies", signed.count()).select(
        "doc_id", "class_id", "n_links", "n_copies", F.col("text_hash").alias("text_key"), kept.alias("kept")
    )
