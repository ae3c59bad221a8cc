"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its own bytes says so; a chunk moves once, to be held against the chunks
of the same hash, byte for byte, and so gets a verified identifier.  After that only recipes, the ordered lists of
a document's identifiers, are compared: two texts are equal exactly when their recipes are.

Defined cases: a null text is an empty one (an empty recipe); rows that repeat a doc_id are separate rows, and of
equal texts with equal doc_ids one row stays; a null doc_id comes before all others; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.chunking import cut_candidates, cuts
from tidebar.llm.common import Scratch, join_counted, slices
from tidebar.llm.encoder import flat_bytes

_CUT = pa.schema(
    [
        ("row", pa.int64()), ("pos", pa.int32()), ("hash", pa.binary()), ("body", pa.binary()),
        ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("hashes", pa.list_(pa.binary())),
    ]
)
_CUT_SQL = "row long, pos int, hash binary, body binary, doc_id long, text_sha256 string, hashes array<binary>"


def cut_documents(bits: int, least: int, most: int, hash_bytes: int):
    """For mapInArrow: a row for each chunk (row, pos, hash, body), and one for each document (its hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            raw, at = flat_bytes(texts)
            body, at = raw.tobytes(), at.tolist()
            candidates = cut_candidates(raw, bits)
            rows = batch.column("row").to_pylist()
            out = {name: [] for name in ("row", "pos", "hash", "body")}
            recipes, digests = [], []
            for k, row in enumerate(rows):
                begin, recipe = at[k], []
                for end in cuts(candidates, begin, at[k + 1], least, most):
                    chunk = body[begin:end]
                    h = xxhash.xxh3_128_digest(chunk)[:hash_bytes]
                    out["row"].append(row), out["pos"].append(len(recipe))
                    out["hash"].append(h), out["body"].append(chunk)
                    recipe.append(h)
                    begin = end
                recipes.append(recipe)
                digests.append(hashlib.sha256(body[at[k] : at[k + 1]]).hexdigest())
            n = len(out["row"])
            yield pa.record_batch(
                [
                    pa.array(out["row"] + rows, pa.int64()), pa.array(out["pos"] + [-1] * len(rows), pa.int32()),
                    pa.array(out["hash"] + [None] * len(rows), pa.binary()),
                    pa.array(out["body"] + [None] * len(rows), pa.binary()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), batch.column("doc_id").cast(pa.int64())]),
                    pa.array([None] * n + digests, pa.string()), pa.array([None] * n + recipes, _CUT.field("hashes").type),
                ],
                schema=_CUT,
            )

    return run


def exact_dedup(
    docs: DataFrame, bits: int = 11, least: int = 512, most: int = 16384, hash_bytes: int = 16
) -> DataFrame:
    """One row a document: row, doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    A chunk's identifier is its hash and, where several chunks share the hash, its rank among them by content, so
    a collision never merges texts.  Chunks and recipes are exchanged by key with partial aggregates below, so a
    group with a large share of all rows reaches its task as one row from each task before; and documents of such a
    group are joined to its row where they are.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    cut = scratch.put(source.mapInArrow(cut_documents(bits, least, most, hash_bytes), _CUT_SQL), "cut")
    chunks = cut.where("pos >= 0")
    verified = chunks.select("hash", "body").distinct()
    bodies = verified.groupBy("hash").agg(F.count("*").alias("bodies"))
    shared = scratch.put(bodies.where("bodies > 1").select("hash"), "shared")
    recipes = cut.where("pos = -1").select("row", "doc_id", "text_sha256", F.col("hashes").alias("recipe"))
    if not shared.isEmpty():
        ranks = chunks.join(shared, "hash", "left_semi").select("hash", "body").distinct().select(
            "hash", "body", F.row_number().over(W.partitionBy("hash").orderBy("body")).alias("rank")
        )
        ranked = chunks.join(shared, "hash", "left_semi").join(ranks, ["hash", "body"])
        suffix = ranked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
        # longer than any bare hash, so never equal to one
        with_rank = F.transform(
            "recipe",
            lambda h, i: F.when(
                F.col("ranks")[i].isNotNull(), F.concat(h, F.encode(F.col("ranks")[i].cast("string"), "UTF-8"))
            ).otherwise(h),
        )
        recipes = recipes.join(suffix, "row", "left").withColumn(
            "recipe", F.when(F.col("ranks").isNull(), F.col("recipe")).otherwise(with_rank)
        )
    # null ids last: struct order puts null first, so the largest (doc_id, row) is a row with an id where there is one
    groups = recipes.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )
    groups = scratch.put(groups, "groups")
    found = join_counted(recipes, groups, ["recipe"], "group_size", recipes.count()).select(
        "row", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )
    found = scratch.put(found, "found")
    for name in ("cut", "shared", "groups"):  # the chunks are as large as the texts
        scratch.drop(name)
    return found
