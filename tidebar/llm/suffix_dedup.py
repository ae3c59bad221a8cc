"""Removal of passages that repeat an earlier document's, by suffixes of the whole collection.

A byte goes when it is covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id.

1. Texts are gathered in batches of bounded size, in one table that is bucketed by batch, so they are exchanged once.
2. Every window of ``width`` bytes has a least k-gram hash, and equal windows have the same one.  Only these hashes
   (for about one byte in 14) are exchanged, packed, to find the k-grams that occur more than once.
3. The strings around such k-grams (a k-gram with all windows whose least it is) go to their k-gram's bucket, equal
   ones of a batch once with the least doc_id.  Windows of a k-gram with very many strings are dealt one by one,
   by their own hash, so no k-gram's strings meet in one task.
4. A bucket's strings are one collection.  Windows whose rolling hash no string of another owner has can't be answered
   otherwise than by themselves, so strings lose them at their ends, or go; of what is left, the Burrows-Wheeler
   transform and common prefixes are built column by column (see ``bwt``); suffixes that share ``width`` bytes or more
   are neighbours there, and the least doc_id of such a run says which of its windows go.
5. These answers, a bit a window, go back to the batches, where the texts are.

Hashes only say which strings can't be equal; what is equal, the transform says.

Defined cases: a null text is an empty one; a null doc_id comes before all others; rows that repeat a doc_id are
documents of the same rank, which take nothing from each other; texts shorter than ``width`` keep all; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.bwt import least_owner
from tidebar.llm.common import Scratch, slices
from tidebar.llm.encoder import flat_bytes, ragged

GRAM = 24
_LEAST_ID, _MOST_ID = -(1 << 63), (1 << 63) - 1
_C = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PART = 1 << 17


def _words(raw: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as one number."""
    out = np.empty(n, np.uint64)
    body = raw.tobytes()
    for s in range(min(8, n)):
        m = -(-(n - s) // 8)
        out[s::8] = np.frombuffer(body, "<u8", m, s)
    return out


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = _words(np.append(raw, np.zeros(8, np.uint8)), n + GRAM - 8)
    h = words[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h = (h + words[8 : n + 8]) * _C[1]
    h ^= h >> np.uint64(32)
    h = (h + words[16 : n + 16]) * _C[2]
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def least_hashes(raw: np.ndarray, skip: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, place, hash): the least k-gram hash of every window, 0 where ``skip``; the k-grams that are some least.

    Works through the bytes in parts, so the larger arrays are of bounded size.
    """
    span, n = width - GRAM + 1, max(len(raw) - width + 1, 0)
    least, places, hashes = np.empty(n, np.uint64), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, n, _PART):
        b = min(a + _PART, n)  # windows a..b - 1
        h = _gram_hashes(raw[a : b + width - 1])
        own = _sliding(h, span, np.minimum)
        own[skip[a:b]] = 0
        least[a:b] = own
        edge = np.zeros(span - 1, np.uint64)
        place = np.flatnonzero(h == _sliding(np.concatenate([edge, own, edge]), span, np.maximum))
        places.append(place + a), hashes.append(h[place])
    place, at = np.unique(np.concatenate(places), return_index=True)
    return least, place, np.concatenate(hashes)[at]


def reach(least: np.ndarray, place: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last window whose least hash is that of the k-gram at ``place``; they are consecutive."""
    first, last = np.full(len(place), -1), np.full(len(place), -1)
    for d in range(width - GRAM + 1):
        window = place - d
        inside = (window >= 0) & (window < len(least))
        on = inside & (least[np.where(inside, window, 0)] == own) if len(least) else inside
        first = np.where(on, window, first)
        last = np.where(on & (last < 0), window, last)
    return first, last


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper bits, so grams in ascending order are in the order of their buckets, too."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _arrays(packed: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts, one row each."""
    base, k = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, most=2_000_000):
        raw, at = flat_bytes(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
        ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), _LEAST_ID).to_numpy()
        yield pa.record_batch(
            [
                pa.array([base + k]), pa.array([ids.tobytes()], pa.binary()),
                pa.array([np.diff(at).astype(np.int64).tobytes()], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=3).compress(raw.tobytes())], pa.binary()),
            ],
            names=["batch", "ids", "sizes", "body"],
        )
        k += 1


class _Batch:
    """A batch's texts, and its k-grams in the order of buckets."""

    def __init__(self, row: dict, width: int, buckets: int):
        self.ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        self.raw = np.frombuffer(unpack(row["body"], max_output_size=int(sizes.sum()) + 1), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.width, self.buckets = width, buckets

    def look(self) -> None:
        """Finds the least hashes of the windows that lie in one text."""
        skip = np.zeros(len(self.raw), bool)
        ends = self.at[1:]
        begin = np.maximum(ends - self.width + 1, self.at[:-1])
        skip[ragged(begin, ends - begin)] = True
        self.least, self.place, self.hash = least_hashes(self.raw, skip, self.width)
        spread = self.hash * _C[1]  # least hashes are small ones
        order = np.argsort(spread)
        ordered = spread[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.cumsum(new) - 1
        self.grams = ordered[new]
        self.gram_bucket = _bucket(self.grams, self.buckets)
        self.uses = np.bincount(self.gram, minlength=len(self.grams))

    def strings(self, state: np.ndarray):
        """Different strings of k-grams in state 1, whole, and 2, by window, in the order of buckets; and occurrences.

        (texts, buckets, least ids), and for each anchor or window: (string, doc, first window, windows).  A string's
        k-gram follows from it, so equal strings have the same bucket.
        """
        body, at, width = self.raw.tobytes(), self.at, self.width
        on = np.flatnonzero(state[self.gram] > 0)
        hot = state[self.gram[on]] == 2
        begin, last = reach(self.least, self.place[on], self.hash[on], width)
        windows = last - begin + 1
        each = np.where(hot, windows, 1)
        first = np.repeat(begin, each) + ragged(np.zeros(len(on), np.int64), each)
        windows = np.repeat(np.where(hot, 1, windows), each)
        hot = np.repeat(hot, each)
        doc = np.searchsorted(at, first, "right") - 1
        numbers: dict[bytes, int] = {}
        stops = first + windows + width - 1
        texts = [body[a:b] for a, b in zip(first.tolist(), stops.tolist(), strict=True)]
        string = np.fromiter((numbers.setdefault(x, len(numbers)) for x in texts), np.int64, len(texts))
        bucket = np.empty(len(numbers), np.int64)
        bucket[string] = np.repeat(self.gram_bucket[self.gram[on]], each)
        different = list(numbers)
        for k in np.unique(string[hot]).tolist():
            bucket[k] = xxhash.xxh3_64_intdigest(different[k]) % self.buckets
        owner = np.full(len(numbers), _MOST_ID)
        np.minimum.at(owner, string, self.ids[doc])
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return ([different[k] for k in order.tolist()], bucket[order], owner[order]), (rank[string], doc, first, windows)


def _runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted column."""
    which, begin = np.unique(bucket, return_index=True)
    return list(zip(which.tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True))


def _unpacked(table: pa.Table, runs: list[tuple[int, int, int]], sizes: np.ndarray) -> np.ndarray:
    """Bits of a batch's buckets, end to end; bucket runs[k] has those of the items from..to, each of ``sizes`` bits."""
    found = dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True))
    bits = [np.unpackbits(np.frombuffer(found[w], np.uint8), count=int(sizes[x:y].sum())) for w, x, y in runs]
    return np.concatenate([np.empty(0, np.uint8), *bits]).astype(bool)


_STATES = "batch long, bucket long, state binary"


def _gram_rows(width: int, buckets: int):
    """For mapInArrow: a row for each batch and bucket: k-gram hashes, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for r in table.to_pylist():
                b = _Batch(r, width, buckets)
                b.look()
                uses = np.minimum(b.uses, 255).astype(np.uint8)
                runs = _runs(b.gram_bucket)
                yield pa.record_batch(
                    [
                        pa.array([w for w, _, _ in runs], pa.int64()), pa.array([r["batch"]] * len(runs), pa.int64()),
                        pa.array([b.grams[x:y].tobytes() for _, x, y in runs], pa.binary()),
                        pa.array([uses[x:y].tobytes() for _, x, y in runs], pa.binary()),
                    ],
                    names=["bucket", "batch", "grams", "uses"],
                )

    return run


def _shared_grams(hot: int):
    """For applyInArrow by bucket: for each batch, its k-grams' states: 0 alone, 1 shared, 2 shared by very many."""

    def run(table: pa.Table) -> pa.Table:
        batch, bucket = table.column("batch"), table.column("bucket")
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        uses = np.frombuffer(b"".join(table.column("uses").to_pylist()), np.uint8).astype(np.int64)
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, uses)[which]
        state = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        parts = [x.tobytes() for x in np.split(state, np.cumsum([len(g) for g in grams])[:-1])]
        return pa.table({"batch": batch, "bucket": bucket, "state": pa.array(parts, pa.binary())})

    return run


def _string_rows(width: int, buckets: int):
    """For applyInArrow over (batch, states): a row for each bucket: lengths, bytes and least ids of its strings.

    One row more, of a bucket of its own, has what the batch needs of them at the end.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "batch", "lengths", "body", "owner")}
        if left.num_rows:
            r = left.to_pylist()[0]
            b = _Batch(r, width, buckets)
            b.look()
            state = np.frombuffer(b"".join(right.sort_by("bucket").column("state").to_pylist()), np.uint8)
            (texts, bucket, owner), (string, doc, first, windows) = b.strings(state)
            runs = _runs(bucket)
            for w, x, y in runs:
                out["bucket"].append(w), out["batch"].append(r["batch"])
                out["lengths"].append(np.array([*map(len, texts[x:y])], np.uint8).tobytes())
                out["body"].append(zstandard.ZstdCompressor(level=1).compress(b"".join(texts[x:y])))
                out["owner"].append(owner[x:y].tobytes())
            sizes = np.array([*map(len, texts)], np.int64) - width + 1
            later = b.ids[doc] > owner[string]
            out["bucket"].append(-1 - r["batch"]), out["batch"].append(r["batch"])
            narrow = [x.astype(np.int32) for x in (bucket, sizes, string, first, windows)]
            out["lengths"].append(None), out["owner"].append(None), out["body"].append(_packed(*narrow, later))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


def _answers(width: int):
    """For applyInArrow by bucket: for each batch, a bit for each window of its strings: a lesser id has it too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": table.column("body")})
        unpack = zstandard.ZstdDecompressor().decompress
        lengths = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table.column("lengths").to_pylist()]
        sizes = [int(x.sum()) for x in lengths]
        body = b"".join(unpack(x, max_output_size=n + 1) for x, n in zip(table.column("body").to_pylist(), sizes, strict=True))
        owner = np.frombuffer(b"".join(table.column("owner").to_pylist()), np.int64)
        counts = [len(x) for x in lengths]
        lengths = np.concatenate(lengths)
        numbers: dict[bytes, int] = {}
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        parts = [body[a:b] for a, b in zip(at, at[1:], strict=False)]
        string = np.fromiter((numbers.setdefault(x, len(numbers)) for x in parts), np.int64, len(parts))
        least = np.full(len(numbers), _MOST_ID)
        np.minimum.at(least, string, owner)
        own_lengths = np.array([*map(len, numbers)], np.int64)
        found, windows = least_owner(np.frombuffer(b"".join(numbers), np.uint8), own_lengths, least, width)
        begin = np.cumsum(windows) - windows
        each = windows[string]
        smaller = found[ragged(begin[string], each)] < np.repeat(owner, each)
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *counts])].tolist()
        bits = [np.packbits(smaller[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _removed(width: int, buckets: int):
    """For applyInArrow over (batch, bits): what goes of each document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in _RESULT.split(", ", 5)}
        if left.num_rows:
            r = left.to_pylist()[0]
            b = _Batch(r, width, buckets)
            own = pc.less(right.column("bucket"), 0)
            bucket, sizes, string, first, windows, later = _arrays(right.filter(own).column("bits").to_pylist()[0])
            answers = right.filter(pc.invert(own))
            bits = _unpacked(answers, _runs(bucket), sizes)
            begin = np.cumsum(sizes, dtype=np.int64) - sizes
            gone = bits[ragged(begin[string], windows)] | np.repeat(later, windows)
            begins = np.zeros(len(b.raw), bool)
            begins[ragged(first, windows)[gone]] = True
            edge = np.cumsum(np.concatenate([[0], begins]))
            n = len(begins)
            covered = edge[1:] > edge[np.maximum(np.arange(n) + 1 - width, 0)]
            at = b.at.tolist()
            for k, doc_id in enumerate(b.ids.tolist()):
                own = covered[at[k] : at[k + 1]]
                steps = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                out["doc_id"].append(None if doc_id == _LEAST_ID else doc_id)
                out["n_bytes"].append(len(own))
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(len(steps) // 2)
                out["kept_sha256"].append(hashlib.sha256(b.raw[at[k] : at[k + 1]][~own].tobytes()).hexdigest())
                out["spans"].append([{"start": x, "end": y} for x, y in steps.reshape(-1, 2).tolist()])
        types = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


def remove_repeats(
    docs: DataFrame, width: int = 50, bucket_bytes: int = 3_000_000, hot: int = 20_000,
    task_bytes: int = 32_000_000, least_tasks: int = 8,
) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets that go).

    ``bucket_bytes`` of text make a bucket and ``task_bytes`` a task, so tasks don't grow with the input; a k-gram that occurs more than ``hot`` times is dealt by windows.
    """
    if width < 2 * GRAM or width - GRAM > 128:
        raise ValueError(f"width is from {2 * GRAM} to {GRAM + 128}")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, tasks = max(1, -(-total // bucket_bytes)), max(least_tasks, -(-total // task_bytes))
    held = source.mapInArrow(_gather, "batch long, ids binary, sizes binary, body binary")
    held = scratch.put_bucketed(held, "batches", "batch", tasks)

    by_batch = held.groupBy("batch")
    grams = held.mapInArrow(_gram_rows(width, buckets), "bucket long, batch long, grams binary, uses binary")
    states = grams.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_shared_grams(hot), _STATES)
    states = scratch.put(states, "states")
    strings = by_batch.cogroup(states.groupBy("batch")).applyInArrow(
        _string_rows(width, buckets), "bucket long, batch long, lengths binary, body binary, owner binary"
    )
    bits = strings.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answers(width), "batch long, bucket long, bits binary")
    bits = scratch.put(bits, "bits")
    return by_batch.cogroup(bits.groupBy("batch")).applyInArrow(_removed(width, buckets), _RESULT)
