"""Token ids in a content-addressed store.

Whole texts are encoded, each document's id stream is cut where a rolling hash of the ids says so, and every
different chunk is stored once under the SHA-256 of its bytes.  The store is a folder of three Parquet tables:

``chunks``     digest, n_ids, ids (little-endian unsigned, 2 or 4 bytes each, as the vocabulary needs)
``recipes``    in ascending doc_id order: file, doc_id, start, n_tokens, digests in order, root
``manifests``  file, documents, tokens, root

``root`` is the Merkle root of a document's digests; a file's root is that of its documents' roots.  ``verify`` takes
all of them anew and holds them against the stored ones, ``read_ids`` rebuilds every document's ids from the stored
bytes, and ``read_back`` their number, place and CRC-32.

Defined cases: a null text is an empty one (its end id alone); equal doc_ids keep the order of their rows; null
doc_ids come first; an empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.chunking import cut_candidates, cuts
from tidebar.llm.common import Scratch, prefix_sums, slices
from tidebar.llm.encoder import encoder, greatest_id, vocabulary_path

_CUT = pa.schema(
    [
        ("digest", pa.binary()), ("ids", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary()),
    ]
)
_CUT_SQL = "digest binary, ids binary, row long, doc_id long, n_tokens long, digests array<binary>, root binary"


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 over pairs, level by level; an odd node goes up as it is; of nothing, that of no bytes."""
    if not leaves:
        return hashlib.sha256().digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[2 * len(pairs) :]
    return leaves[0]


def cut_ids(path: str, end_id: int, width: int, bits: int, least: int, most: int):
    """For mapInArrow: encodes and cuts; a row for each chunk new to the batch, and one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_many
        for batch in slices(batches):
            done = encode(batch.column("text"))
            ids = np.insert(done.ids, done.starts[1:], np.uint32(end_id))
            at = (done.starts + np.arange(len(done.starts))).tolist()
            body = memoryview(ids.astype(f"<u{width}").tobytes())
            candidates = cut_candidates(ids, bits)
            chunks, recipes, roots = {}, [], []
            for a, b in pairwise(at):
                recipe = []
                for end in cuts(candidates, a, b, least, most):
                    chunk = body[width * a : width * end]
                    digest = hashlib.sha256(chunk).digest()
                    chunks[digest] = chunk
                    recipe.append(digest)
                    a = end
                recipes.append(recipe)
                roots.append(merkle_root(recipe))
            n, m = len(chunks), batch.num_rows
            no_int = pa.nulls(n, pa.int64())
            yield pa.record_batch(
                [
                    pa.array([*chunks, *[None] * m], pa.binary()),
                    pa.array([*map(bytes, chunks.values()), *[None] * m], pa.binary()),
                    pa.concat_arrays([no_int, batch.column("row").cast(pa.int64())]),
                    pa.concat_arrays([no_int, batch.column("doc_id").cast(pa.int64())]),
                    pa.concat_arrays([no_int, pa.array(np.diff(at), pa.int64())]),
                    pa.array([*[None] * n, *recipes], _CUT.field("digests").type),
                    pa.array([*[None] * n, *roots], pa.binary()),
                ],
                schema=_CUT,
            )

    return run


def write_store(
    docs: DataFrame, root: str, end_id: int = 1, path: str | None = None, bits: int = 10, least: int = 256,
    most: int = 8192, rows_per_file: int = 100_000,
) -> None:
    """Writes the store to the folder ``root``; ids of vocabularies above 65,536 take 4 bytes, others 2."""
    path = path or vocabulary_path()
    width = 2 if max(greatest_id(path), end_id) < 1 << 16 else 4
    spark = docs.sparkSession
    scratch = Scratch(spark, "id-store")
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    work = cut_ids(path, end_id, width, bits, least, most)
    cut = scratch.put(source.mapInArrow(work, _CUT_SQL), "cut")
    chunks = cut.where("digest IS NOT NULL").select("digest", "ids").distinct()
    chunks = chunks.select("digest", (F.octet_length("ids") / width).cast("long").alias("n_ids"), "ids")
    chunks.write.option("compression", "zstd").parquet(f"{root}/chunks")
    recipes = cut.where("digest IS NULL").drop("digest", "ids")
    order = [F.col("doc_id"), F.col("row")]
    placed = prefix_sums(recipes, order, "n_tokens", "start", scratch, rows_per_file)
    n = max(1, -(-recipes.count() // rows_per_file))
    placed = placed.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    placed = placed.select(F.spark_partition_id().alias("file"), "doc_id", "row", "start", "n_tokens", "digests", "root")
    placed.write.option("compression", "zstd").parquet(f"{root}/recipes")
    manifests(spark.read.parquet(f"{root}/recipes")).write.parquet(f"{root}/manifests")
    scratch.drop("cut")


def _checked_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digests, root in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if merkle_root(digests) != root:
                raise ValueError(f"a document's root is not that of its digests, but {root.hex()}")
        yield batch.drop_columns(["digests"])


def manifests(recipes: DataFrame) -> DataFrame:
    """One row a recipe file, its root from its documents' stored roots, of which a file has a bounded number.

    Fails where a document's root is not that of its digests.
    """
    columns = "file int, start long, row long, n_tokens long, root binary"
    checked = recipes.select("file", "start", "row", "n_tokens", "root", "digests").mapInArrow(_checked_roots, columns)

    def of_file(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("start", "ascending"), ("row", "ascending")])
        roots = rows.column("root").to_pylist()
        total = sum(rows.column("n_tokens").to_pylist())
        return pa.table(
            {
                "file": pa.array([key[0].as_py()], pa.int32()), "documents": pa.array([len(roots)], pa.int64()),
                "tokens": pa.array([total], pa.int64()), "root": pa.array([merkle_root(roots)], pa.binary()),
            }
        )

    return checked.groupBy("file").applyInArrow(of_file, "file int, documents long, tokens long, root binary")


def verify(spark: SparkSession, root: str) -> None:
    """Raises where a manifest is not that of its recipes, or a document's root not that of its digests.

    Chunks are held against their digests wherever they are read.
    """
    stored = spark.read.parquet(f"{root}/manifests")
    again = manifests(spark.read.parquet(f"{root}/recipes"))
    if not stored.exceptAll(again).isEmpty() or not again.exceptAll(stored).isEmpty():
        raise ValueError(f"the manifests in {root} are not those of its recipes")


def _crc_tables(levels: int = 44) -> np.ndarray:
    """For each k, what 2**k zero bytes after it do to a CRC-32, as four tables of 256 by the CRC's bytes."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1)
    byte = np.arange(256, dtype=np.uint32)
    step = np.stack([row, byte, byte << 8, byte << 16])
    step[0] = row[byte]
    # one zero byte: crc -> (crc >> 8) ^ row[crc & 255]
    out = [step]
    for _ in range(levels - 1):
        out.append(_shift_by(out[-1], out[-1].ravel()).reshape(4, 256))
    return np.stack(out)


def _shift_by(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shift_crc(crc: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they stand in the CRC of a longer text: with so many bytes after them."""
    crc, zero_bytes = crc.astype(np.uint32), zero_bytes.astype(np.int64)
    for k, tables in enumerate(_crc_tables()):
        on = (zero_bytes >> k & 1).astype(bool)
        if on.any():
            crc[on] = _shift_by(tables, crc[on])
    return crc


def _checked(digests: list[bytes], bodies: list[bytes]) -> None:
    for digest, ids in zip(digests, bodies, strict=True):
        if hashlib.sha256(ids).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not match its digest")


def _checked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, counts = batch.column("ids").to_pylist(), batch.column("n_ids").to_pylist()
        _checked(batch.column("digest").to_pylist(), bodies)
        wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(bodies, counts, strict=True)]
        crcs = pa.array([zlib.crc32(x) for x in wide], pa.int64())
        counts = pa.array([len(x) // 4 for x in wide], pa.int64())
        yield pa.record_batch([batch.column("digest"), counts, crcs], names=["digest", "n_ids", "crc"])


def _wide_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, counts = batch.column("ids").to_pylist(), batch.column("n_ids").to_pylist()
        _checked(batch.column("digest").to_pylist(), bodies)
        ids = [np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) for x, n in zip(bodies, counts, strict=True)]
        yield pa.record_batch([batch.column("digest"), pa.array(ids, pa.list_(pa.int64()))], names=["digest", "ids"])


_NOT_STORED = "a recipe names a chunk that is not stored"


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """One row a document, from the stored files: doc_id, start, ids; every chunk is held against its digest."""
    chunks = spark.read.parquet(f"{root}/chunks").select("digest", "n_ids", "ids")
    chunks = chunks.mapInArrow(_wide_chunks, "digest binary, ids array<long>")
    recipes = spark.read.parquet(f"{root}/recipes")
    parts = recipes.select("doc_id", "row", "start", F.posexplode("digests").alias("pos", "digest"))
    found = parts.join(chunks, "digest", "left").withColumn(
        "ids", F.coalesce("ids", F.raise_error(F.lit(_NOT_STORED)).cast("array<long>"))
    )
    whole = found.groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.flatten(F.col("parts.ids")).alias("ids"))


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
        part = pa.array(shift_crc(crc, 4 * after), pa.int64())
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "row", "start", "n_ids")), part],
            names=["doc_id", "row", "start", "n_ids", "part"],
        )


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """One row a document, from the stored files: doc_id, start, n_tokens, ids_crc32.

    Every stored chunk is read and held against its digest; a document's CRC-32 is put together from those of its
    chunks, so the ids themselves are not exchanged again.
    """
    stored = spark.read.parquet(f"{root}/chunks").select("digest", "n_ids", "ids")
    chunks = stored.mapInArrow(_checked_chunks, "digest binary, n_ids long, crc long")
    recipes = spark.read.parquet(f"{root}/recipes")
    parts = recipes.select("doc_id", "row", "start", F.posexplode("digests").alias("pos", "digest"))
    found = parts.join(chunks, "digest", "left").withColumn(
        "n_ids", F.coalesce("n_ids", F.raise_error(F.lit(_NOT_STORED)).cast("long"))
    )
    later = W.partitionBy("row").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("after", F.coalesce(F.sum("n_ids").over(later), F.lit(0)))
    found = found.select("doc_id", "row", "start", "n_ids", "crc", "after")
    shifted = found.mapInArrow(_shifted, "doc_id long, row long, start long, n_ids long, part long")
    return shifted.groupBy("row", "doc_id", "start").agg(
        F.sum("n_ids").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32")
    ).select("doc_id", "start", "n_tokens", "ids_crc32")
