"""Bytes in MPEG transport streams, and what is read back from them.

``mux`` carries each payload as one private elementary stream: a program association table, a program map table,
and packetised units of 16 KiB with presentation times, the first of every eight marked as a random access point.
``demux`` parses the tables, checks the continuity counters, reassembles the packets and returns the payload with
its times and random access points.

Defined cases: a null text is an empty one (one block of zeros); rows that repeat a doc_id are separate rows; a
stream of lost, swapped or damaged packets raises; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, slices
from tidebar.llm.encoder import flat_bytes, ragged

PACKET, BODY, FIRST_BODY = 188, 184, 182
MAP_PID, STREAM_PID, PRIVATE = 0x1000, 0x100, 0x06
UNIT, TICKS, KEY_EVERY, BLOCK = 16384, 3600, 8, 64


def _crc32_mpeg(section: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table: int, body: bytes) -> bytes:
    section = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += _crc32_mpeg(section).to_bytes(4, "big")
    head = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    programs = b"\x00\x01" + (0xE000 | MAP_PID).to_bytes(2, "big")
    streams = (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    streams += bytes([PRIVATE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _table_packet(0, 0, programs) + _table_packet(MAP_PID, 2, streams)


TABLES = _tables()


def _unit_header(k: int, length: int) -> bytes:
    t = k * TICKS
    time = bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])
    return b"\x00\x00\x01\xbd" + (length + 8).to_bytes(2, "big") + b"\x80\x80\x05" + time


def mux(payloads: list[memoryview]) -> list[bytes]:
    """A transport stream for each payload; all packets are laid out at once."""
    stream, sizes, nth, of_payload = [], [], [], []
    for p, payload in enumerate(payloads):
        for k, a in enumerate(range(0, len(payload), UNIT)):
            part = payload[a : a + UNIT]
            stream += (_unit_header(k, len(part)), part)
            sizes.append(len(part) + 14), nth.append(k), of_payload.append(p)
    sizes, nth, of_payload = np.array(sizes, np.int64), np.array(nth), np.array(of_payload)
    raw = np.frombuffer(b"".join(stream), np.uint8)
    per_unit = 1 + -(-np.maximum(sizes - FIRST_BODY, 0) // BODY)
    unit = np.repeat(np.arange(len(sizes)), per_unit)
    k = np.arange(len(unit)) - np.repeat(np.cumsum(per_unit) - per_unit, per_unit)
    offset = np.where(k == 0, 0, FIRST_BODY + (k - 1) * BODY)
    length = np.minimum(sizes[unit] - offset, np.where(k == 0, FIRST_BODY, BODY))
    field = BODY - length  # bytes of adaptation field
    packets = np.full((len(unit), PACKET), 0xFF, np.uint8)
    packets[:, 0] = 0x47
    packets[:, 1] = np.where(k == 0, 0x40, 0) | STREAM_PID >> 8
    packets[:, 2] = STREAM_PID & 0xFF
    per_payload = np.bincount(of_payload[unit], minlength=len(payloads))
    begin = np.cumsum(per_payload) - per_payload
    counter = (np.arange(len(unit)) - begin[of_payload[unit]]) & 15
    packets[:, 3] = np.where(field > 0, 0x30, 0x10) | counter
    some, more = field > 0, field > 1
    packets[some, 4] = field[some] - 1
    packets[more, 5] = np.where((k == 0) & (nth[unit] % KEY_EVERY == 0), 0x40, 0)[more]
    packets.reshape(-1)[ragged(np.arange(len(unit)) * PACKET + PACKET - length, length)] = raw
    body = memoryview(packets.reshape(-1))
    ends = (begin + per_payload).tolist()
    return [TABLES + bytes(body[a * PACKET : b * PACKET]) for a, b in zip(begin.tolist(), ends, strict=True)]


@dataclass
class Demuxed:
    payload: bytes
    times: list[int]
    access_points: list[int]  # of units
    packets: int


def _section(packets: np.ndarray, pid: np.ndarray, which: int, table: int) -> bytes:
    at = np.flatnonzero((pid == which) & (packets[:, 1] & 0x40 > 0))
    if not len(at):
        raise ValueError(f"no table with PID {which}")
    body = packets[at[0], 4:].tobytes()
    section = body[1 + body[0] :]
    length = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    if section[0] != table or _crc32_mpeg(section[:length]):
        raise ValueError(f"the table with PID {which} is damaged")
    return section[8 : length - 4]


_KNOWN: dict[bytes, int] = {}


def _stream_pid(packets: np.ndarray, pid: np.ndarray) -> int:
    """The private stream's PID by the two tables, which are parsed once for equal table packets."""
    key = packets[:2].tobytes()
    if key not in _KNOWN:
        programs = _section(packets, pid, 0, 0)
        map_pid = int.from_bytes(programs[2:4], "big") & 0x1FFF
        streams = _section(packets, pid, map_pid, 2)
        at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
        found = None
        while at < len(streams):
            if streams[at] == PRIVATE:
                found = int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
            at += 5 + (int.from_bytes(streams[at + 3 : at + 5], "big") & 0xFFF)
        if found is None:
            raise ValueError("the program has no private stream")
        _KNOWN.clear()
        _KNOWN[key] = found
    return _KNOWN[key]


def demux(media: bytes) -> Demuxed:
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any() or (packets[:, 1] & 0x80).any():
        raise ValueError("a packet is damaged")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    own = packets[pid == _stream_pid(packets, pid)]
    counter = own[:, 3] & 15
    if (np.diff(counter.astype(np.int16)) % 16 != 1).any():
        raise ValueError("continuity is broken")
    has_field = own[:, 3] & 0x20 > 0
    begin = 4 + np.where(has_field, 1 + own[:, 4].astype(np.int64), 0)
    stream = own.reshape(-1)[ragged(np.arange(len(own)) * PACKET + begin, PACKET - begin)].tobytes()
    first = own[:, 1] & 0x40 > 0
    ends = np.cumsum(PACKET - begin)
    starts = (ends - (PACKET - begin))[first].tolist()
    access = (has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0))[first]
    parts, times = [], []
    for a, b in pairwise([*starts, len(stream)]):
        if stream[a : a + 4] != b"\x00\x00\x01\xbd" or int.from_bytes(stream[a + 4 : a + 6], "big") != b - a - 6:
            raise ValueError("an elementary packet is damaged")
        t = stream[a + 9 : a + 14]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        parts.append(stream[a + 9 + stream[a + 8] : b])
    return Demuxed(b"".join(parts), times, np.flatnonzero(access).tolist(), len(packets))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, at = flat_bytes(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
        lengths = np.diff(at)
        padded = np.maximum(-(-lengths // BLOCK), 1) * BLOCK
        places = np.cumsum(padded) - padded
        block = np.zeros(int(padded.sum()), np.uint8)
        block[ragged(places, lengths)] = raw
        view = memoryview(block)
        ends = (places + padded).tolist()
        media = mux([view[a:b] for a, b in zip(places.tolist(), ends, strict=True)])
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


_READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, times array<long>, access_points array<int>"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in slices(batches, "media"):
        cols = {name: [] for name in names[2:]}
        for media in batch.column("media").to_pylist():
            got = demux(media)
            counts = np.bincount(np.frombuffer(got.payload, np.uint8) >> 5, minlength=8)
            cols["payload_bytes"].append(len(got.payload))
            cols["payload_sha256"].append(hashlib.sha256(got.payload).hexdigest())
            cols["tail_crc32"].append(zlib.crc32(got.payload[-BLOCK:]))
            cols["media_bytes"].append(len(media))
            cols["media_sha256"].append(hashlib.sha256(media).hexdigest())
            cols["feature"].append(
                f"packets={got.packets};units={len(got.times)};last={got.times[-1]};"
                f"points={len(got.access_points)};bytes={'/'.join(map(str, counts.tolist()))}"
            )
            cols["times"].append(got.times)
            cols["access_points"].append(got.access_points)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        arrays = [pa.array(c, t) for c, t in zip(cols.values(), types, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *arrays], names=names)


def store_media(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes (of its text), media (its transport stream)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Stores the streams as a Parquet table in the shared folder, reads it back and returns what is in them."""
    stored = Scratch(docs.sparkSession, "media").put(store_media(docs), "media")
    return stored.mapInArrow(_read, _READ)
