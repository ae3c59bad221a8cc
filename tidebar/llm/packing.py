"""Packing token streams into sequences of bounded length, in document order, by dynamic programming.

A run of documents is one stream of ids.  Windows may be cut at ends of documents and of sentences (and every few
dozen ids of a sentence that is longer).  A cut inside a document is penalised, as is padding; the cheapest chain of
windows is found with a monotone queue, since a window's cost is a sum of a term of its start and a term of its end,
and starts leave the front of the queue as they come to lie more than a sequence away.  A window whose length happens
to be a power of two needs no padding; it is a transition of its own, for a fee, so that short sequences stay rare.

Only the last window of a run, which no later document can fill, may be cut anywhere, into powers of two, each for the
fee and the penalty of a cut within a sentence; the programme weighs that against padding it.

Defined cases: a null text is an empty one (its end id alone); a document longer than a sequence spans several;
rows that repeat a doc_id are packed as they come; an empty table gives an empty result; columns besides ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import slices
from tidebar.llm.encoder import encoder, vocabulary_path

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


def powers(length: int) -> list[int]:
    """``length`` as a sum of powers of two, the largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def short_windows(places: np.ndarray, most: int) -> tuple[array, array]:
    """(ends, starts) by number of all pairs of places at a distance that is a power of two below ``most``, ends ascending.

    There are several pairs a place, so they are held in four bytes each.
    """
    ends, starts = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for k in range(most.bit_length()):
        if 1 << k < most:
            at = np.searchsorted(places, places - (1 << k))
            there = np.flatnonzero(places[at] == places - (1 << k))
            ends.append(there.astype(np.int32)), starts.append(at[there].astype(np.int32))
    end, start = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(end, kind="stable")
    return array("i", end[order].tobytes()), array("i", start[order].tobytes())


def choose_cuts(places: np.ndarray, penalty: np.ndarray, most: int, fee: float, anywhere: float) -> list[int]:
    """Places at which windows end, from ``places`` (ascending, the first 0, no two further apart than ``most``).

    cost(end) = penalty(end) + the less of most - place(end) + least over starts in reach of (cost(start) +
    place(start)), and fee + least cost(start) over starts at the distance of a power of two.  The last window may also
    be cut into powers of two, for ``fee`` each and ``anywhere`` a cut.
    """
    ends, starts = short_windows(places, most)
    ends.append(-1)
    nth = 0
    places, penalty = places.tolist(), penalty.tolist()
    cost, came = [0.0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    key = [0.0] * len(places)
    for j in range(1, len(places)):
        here = places[j]
        while here - places[queue[0]] > most:
            queue.popleft()
        i = queue[0]
        best = key[i] + most - here
        while ends[nth] == j:
            s = starts[nth]
            nth += 1
            if cost[s] + fee < best:
                i, best = s, cost[s] + fee
        came[j] = i
        cost[j] = best + penalty[j]
        k = key[j] = cost[j] + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    last = len(places) - 1
    pieces: list[int] = []
    for i in range(last - 1, -1, -1):
        length = places[last] - places[i]
        if length > most:
            break
        parts = powers(length)
        own = cost[i] + fee * len(parts) + anywhere * (len(parts) - 1) + penalty[last]
        if own < cost[last]:
            cost[last], came[last], pieces = own, i, parts
    out, j = [], last
    while j:
        out.append(places[j])
        j = came[j]
    inner = np.cumsum(pieces)[:-1] + places[came[last]] if pieces else []
    return sorted({*out, *map(int, inner)})


class Packer:
    """Packs runs of documents: their ids end to end, where each ends, and where their sentences end."""

    def __init__(self, most: int, inside: float, mid_sentence: float, grid: int, fee: float):
        self.most, self.inside, self.mid_sentence, self.grid, self.fee = most, inside, mid_sentence, grid, fee

    def places(self, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may be cut, and the penalty of each."""
        known = np.union1d(doc_ends, sentence_ends)
        known = np.concatenate([[0], known[known > 0]])
        wide = np.flatnonzero(np.diff(known) > self.grid)
        more = [np.arange(known[k] + self.grid, known[k + 1], self.grid) for k in wide]
        places = np.union1d(known, np.concatenate([np.empty(0, np.int64), *more]))
        penalty = np.full(len(places), self.mid_sentence)
        penalty[np.isin(places, sentence_ends)] = self.inside
        penalty[np.isin(places, doc_ends)] = 0.0
        return places, penalty

    def windows(self, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> list[int]:
        places, penalty = self.places(doc_ends, sentence_ends)
        return choose_cuts(places, penalty, self.most, self.fee, self.mid_sentence)


def pack_partition(path: str, end_id: int, packer: Packer, run_tokens: int):
    """For mapInArrow: packs the documents of a partition as they come, in runs of about ``run_tokens`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(path).encode_many, TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            nonlocal sequence
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            doc_ends = np.cumsum(np.concatenate([h[2] for h in held]))
            shift = np.cumsum([0, *(len(h[1]) for h in held[:-1])])
            sentences = np.concatenate([h[3] + s for h, s in zip(held, shift.tolist(), strict=True)])
            ends = np.array(packer.windows(doc_ends, sentences))
            cuts = np.union1d(doc_ends, ends)
            begins = np.concatenate([[0], cuts[:-1]])
            doc = np.searchsorted(doc_ends, begins, "right")
            window = np.searchsorted(ends, begins, "right")
            doc_begins, window_begins = np.concatenate([[0], doc_ends[:-1]]), np.concatenate([[0], ends[:-1]])
            body = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)]
            out = [
                doc_ids.take(pa.array(doc)), begins - doc_begins[doc], cuts - begins, np.array(crc, np.int64),
                (doc_ends - doc_begins)[doc], sequence + window, begins - window_begins[window],
                (ends - window_begins)[window],
            ]
            sequence += len(ends)
            names = [c.split()[0] for c in _PIECES.split(", ")]
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=names)

        for batch in slices(batches):
            done = encode(batch.column("text"))
            n = batch.num_rows
            lengths = np.diff(done.starts) + 1
            ids = np.insert(done.ids, done.starts[1:], np.uint32(end_id))
            stops = np.array([w[-1] in ".!?" for w in done.words], bool)
            last = stops[done.codes]
            owner = np.repeat(np.arange(n), np.diff(done.segments))
            sentences = (done.ends_of_segments() + owner)[last]
            held.append((batch.column("doc_id").cast(pa.int64()), ids, lengths, sentences))
            size += len(ids)
            if size >= run_tokens:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return run


def pack(
    docs: DataFrame, most: int = 4096, end_id: int = 2, path: str | None = None, inside: float = 8.0,
    mid_sentence: float = 24.0, grid: int = 32, fee: float = 64.0, run_tokens: int = 3_000_000,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Documents keep the order in which they are stored, so nothing is exchanged; a sequence is filled from one
    partition.  ``inside`` and ``mid_sentence`` are the penalties, in ids of padding, of a cut at the end of a
    sentence within a document and of one within a sentence; ``fee`` is that of a sequence whose length is a lesser
    power of two.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = pack_partition(path or vocabulary_path(), end_id, Packer(most, inside, mid_sentence, grid, fee), run_tokens)
    return source.mapInArrow(work, _PIECES)
