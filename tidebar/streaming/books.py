"""Books of symbols as a stream: complete frames behind a barrier, rings of deltas, frames acted on once, appends.

State is Spark's own (``transformWithState`` over its RocksDB store, checkpointed in the shared folder), so a restart goes
on where the checkpoint stands.  All operators take rows in the order of ``seq``, the order of arrival: what comes out
depends on that order alone, not on where micro-batches are cut, as long as a batch holds no earlier seq than the one
before.  A key's rows of one micro-batch are sorted in memory; the stream's admission limit bounds them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from itertools import chain
from math import inf, log
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = {"book": "string", "symbol": "string", "seq": "long", "ts_s": "long", "close": "double"}
FRAMES = "book string, seq long, kind string, sequence long, bucket long, symbol string, close double, delta double, ring_n long, ring_sum double"
FRAME = Row(*(c.split()[0] for c in FRAMES.split(", ")))
HEALTH = "symbol string, state string, ts_s long, received_ms long"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class Book:
    """What a book knows between ticks, and the step that a tick makes.

    A symbol's bucket is staged with its last close when the next bucket begins, if that is its neighbour.  When all
    symbols have staged a bucket later than the last committed one, it is committed: it gets the next sequence, its log
    deltas to the frame before go into the ring, which keeps the last ``ring`` of them, and older staged buckets go.
    ``held`` gives the ring of an earlier run, once it is needed.
    """

    def __init__(self, symbols: tuple[str, ...], width_s: int, ring: int, held: Callable[[], list[list[float]]] = list):
        self.symbols, self.width_s, self.ring = symbols, width_s, ring
        self.building: dict[str, tuple[int, float]] = {}
        self.staged: dict[int, dict[str, float]] = {}
        self.committed, self.sequence = None, 0
        self.last: list[float] | None = None
        self.held, self.deltas = held, None

    def step(self, seq: int, symbol: str, ts_s: int, close: float | None) -> list[tuple]:
        bucket = None if ts_s is None else ts_s // self.width_s
        if symbol not in self.symbols or close is None or not 0 < close < inf:
            return [(seq, "invalid", None, bucket, symbol, close, None, None, None)]
        if bucket is None:
            return []
        held = self.building.get(symbol)
        if held and bucket < held[0]:
            return [(seq, "late", None, bucket, symbol, close, None, None, None)]
        self.building[symbol] = (bucket, close)
        if not held or bucket == held[0]:
            return []
        if bucket == held[0] + 1 and (self.committed is None or held[0] > self.committed):
            self.staged.setdefault(held[0], {})[symbol] = held[1]
        full = sorted(b for b, closes in self.staged.items() if len(closes) == len(self.symbols))
        return [row for b in full for row in self._commit(seq, b)]

    def _commit(self, seq: int, bucket: int) -> list[tuple]:
        closes = [self.staged[bucket][s] for s in self.symbols]
        deltas = [log(c / p) for c, p in zip(closes, self.last, strict=True)] if self.last else None
        self.deltas = self.held() if self.deltas is None else self.deltas
        if deltas:
            self.deltas = [*self.deltas, deltas][-self.ring :]
        self.last, self.committed, self.sequence = closes, bucket, self.sequence + 1
        self.staged = {b: x for b, x in self.staged.items() if b > bucket}
        sums = [sum((d[k] for d in self.deltas), 0.0) for k in range(len(closes))]
        return [
            (seq, "frame", self.sequence, bucket, s, c, deltas[k] if deltas else None, len(self.deltas), sums[k])
            for k, (s, c) in enumerate(zip(self.symbols, closes, strict=True))
        ]


class Barrier(StatefulProcessor):
    """``Book`` with its parts in Spark's state: one value of arrays by symbol, and a list for the ring.

    Each touch of state is a message to the JVM, so a micro-batch takes one read and one write a book; the ring is read
    when a frame is committed, and only then.
    """

    STATE = "building array<bigint>, closes array<double>, buckets array<bigint>, staged array<double>, committed bigint, sequence bigint, last array<double>"

    def __init__(self, symbols: tuple[str, ...], width_s: int, ring: int):
        self.symbols, self.width_s, self.ring = symbols, width_s, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", self.STATE)
        self.deltas = handle.getListState("ring", "delta array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        book = self._read()
        before = book.sequence
        out = [x for _, symbol, seq, ts_s, close in sorted(rows, key=itemgetter(2)) for x in book.step(seq, symbol, ts_s, close)]
        self._write(book)
        if book.sequence > before and book.deltas:
            self.deltas.put([(d,) for d in book.deltas])
        for x in out:
            yield FRAME(key[0], *x)

    def _read(self) -> Book:
        ring = lambda: [d[0] for d in self.deltas.get()]
        book, held = Book(self.symbols, self.width_s, self.ring, ring), self.book.get()
        if held is None:
            return book
        building, closes, buckets, staged, book.committed, book.sequence, last = held
        book.last = None if last is None else list(last)
        book.building = {s: (b, c) for s, b, c in zip(self.symbols, building, closes, strict=True) if b is not None}
        n = len(self.symbols)
        for k, bucket in enumerate(buckets):
            book.staged[bucket] = {s: c for s, c in zip(self.symbols, staged[k * n : (k + 1) * n], strict=True) if c is not None}
        return book

    def _write(self, book: Book) -> None:
        held = [book.building.get(s, (None, None)) for s in self.symbols]
        staged = [closes.get(s) for closes in book.staged.values() for s in self.symbols]
        self.book.update(([b for b, _ in held], [c for _, c in held], list(book.staged), staged, book.committed, book.sequence, book.last))


class Entry:
    """The entry of one book, ``key``, in the map of a block, with the calls that ``Barrier`` makes on a value and on a list."""

    def __init__(self, held: MapState):
        self.map, self.key = held, None

    def get(self) -> tuple | list[tuple] | None:
        return self.map.getValue(self.key)

    def update(self, value: tuple) -> None:
        self.map.updateValue(self.key, value)


class ListEntry(Entry):
    def get(self) -> list[tuple]:
        held = super().get()
        return [] if held is None else [(x,) for x in held[0]]

    def put(self, values: list[tuple]) -> None:
        self.update(([x for x, in values],))


class Blocks(Barrier):
    """``Barrier`` for many books a key, a block, whose ticks come packed: a row, an array and a batch of Arrow's made for each
    tick or book cost more than its step, so a block shares them.  State stays by book, each an entry of the block's maps.
    """

    ROWS = 10_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = Entry(handle.getMapState("book", "book string", self.STATE))
        self.deltas = ListEntry(handle.getMapState("ring", "book string", "deltas array<array<double>>"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ticks, out = {}, []
        for frame in rows:
            for book, symbol, seq, ts_s, close in zip(*(frame[c] for c in TICK), strict=True):
                for row in zip(book, symbol, _longs(seq), _longs(ts_s), close.tolist(), strict=True):
                    ticks.setdefault(row[0], []).append(row)
        for book, found in ticks.items():
            self.book.key = self.deltas.key = (book,)
            out += super().handleInputRows((book,), found, timerValues)
            if len(out) >= self.ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[Row]) -> pd.DataFrame:
        columns = dict(zip(FRAME, zip(*rows, strict=True), strict=True))
        return pd.DataFrame(columns | {c: pd.array(columns[c], "Int64") for c in ("sequence", "bucket", "ring_n")})


def _longs(x: np.ndarray) -> list[int | None]:
    """Longs of an array, which are doubles where some are null."""
    return x.tolist() if x.dtype.kind == "i" else [None if pd.isna(v) else int(v) for v in x]


def _packed(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Ticks to one row for each block of every ``rows`` of them, with a list a column."""
    held = []
    for batch in chain(batches, [None]):
        held += [batch] if batch is not None else []
        if held and (batch is None or sum(b.num_rows for b in held) >= rows):
            lists = pa.Table.from_batches(held).group_by("block", use_threads=False).aggregate([(c, "list") for c in TICK])
            yield from lists.select(["block", *(f"{c}_list" for c in TICK)]).rename_columns(["block", *TICK]).to_batches()
            held = []


def frames(ticks: DataFrame, symbols: list[str], width_s: int, ring: int = 6000, blocks: int = 2048) -> DataFrame:
    """Ticks (book, symbol, seq, ts_s, close) to committed frames, one row for each of ``symbols``, and ticks in error.

    ``ring_n`` and ``ring_sum`` are of the symbol's deltas in the ring.  A tick without a price above 0 or of another
    symbol is ``invalid``, one of an older bucket than its symbol's ``late``; neither changes the book, nor does one without
    a time.  Books go to ``blocks`` keys by hash, a number that a checkpoint fixes; a block's ticks of one micro-batch are
    in memory.
    """
    own = ticks.select(F.pmod(F.xxhash64("book"), F.lit(blocks)).alias("block"), *(F.col(c).cast(t) for c, t in TICK.items()))
    lists = own.mapInArrow(_packed, ", ".join(["block long", *(f"{c} array<{t}>" for c, t in TICK.items())]))
    return lists.groupBy("block").transformWithStateInPandas(Blocks(tuple(symbols), width_s, ring), FRAMES, "append", "none")


class Once(StatefulProcessor):
    """Lets a frame pass if its sequence is above the last that passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acted = handle.getValueState("acted", "sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.acted.get()
        last = before = None if held is None else held[0]
        for _, sequence, bucket in sorted(rows, key=itemgetter(1, 2)):
            if last is None or sequence > last:
                last = sequence
                yield Row(book=key[0], sequence=sequence, bucket=bucket)
        if last != before:
            self.acted.update((last,))


def acted_once(observed: DataFrame) -> DataFrame:
    """Frames (book, sequence, bucket), delivered any number of times and acted on once, in ascending sequence.

    A frame that comes after a later one of its book has been acted on is too old and never acted on.
    """
    own = observed.select("book", "sequence", "bucket")
    return own.groupBy("book").transformWithState(Once(), "book string, sequence long, bucket long", "append", "none")


class Watch(StatefulProcessor):
    """One timer a symbol: the deadline of its next receipt; a receipt moves it."""

    def __init__(self, max_age_ms: int, max_ahead_ms: int):
        self.max_age_ms, self.max_ahead_ms = max_age_ms, max_ahead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts_s long, received_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, own = timerValues.getCurrentProcessingTimeInMs(), pd.concat(list(rows))
        times = own["ts_s"].dropna()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(now + self.max_age_ms)
        if not len(times):
            if not self.seen.exists():
                yield self._row(key, "starting", None, None)
            return
        last = int(times.max())
        if self.seen.exists():
            last = max(last, self.seen.get()[0])
        self.seen.update((last, now))
        age = now - last * 1000
        yield self._row(key, "ahead" if age < -self.max_ahead_ms else "stale" if age > self.max_age_ms else "ok", last, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            yield self._row(key, "silent", *self.seen.get())
        else:
            yield self._row(key, "never started", None, None)

    @staticmethod
    def _row(key: tuple, state: str, ts_s: int | None, received_ms: int | None) -> pd.DataFrame:
        out = pd.DataFrame({"symbol": [key[0]], "state": [state]})
        return out.assign(ts_s=pd.array([ts_s], "Int64"), received_ms=pd.array([received_ms], "Int64"))


def watched(feed: DataFrame, max_age_ms: int, max_ahead_ms: int = 15_000) -> DataFrame:
    """The health of each symbol of ``feed`` (symbol, ts_s) whenever it changes hands: by a row, or by silence.

    A row without ts_s announces a symbol: ``starting``.  A tick makes it ``ok``, ``stale`` (its own time is too old) or
    ``ahead`` (too far in the future).  A symbol from which nothing comes for ``max_age_ms`` is reported by a timer,
    without any new row: ``never started`` before its first tick, ``silent`` after.
    """
    processor = Watch(max_age_ms, max_ahead_ms)
    return feed.select("symbol", "ts_s").groupBy("symbol").transformWithStateInPandas(processor, HEALTH, "update", "ProcessingTime")


class Newest(StatefulProcessor):
    """Lets bars pass that are later than the symbol's last, each bucket once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        own = pd.concat(list(rows)).sort_values(["ts_ms", "close"], kind="stable").drop_duplicates("ts_ms")
        fresh = own if last is None else own[own["ts_ms"] > last]
        if len(fresh):
            self.last.update((int(fresh["ts_ms"].iloc[-1]),))
        yield pd.DataFrame({"symbol": key[0], "ts_ms": fresh["ts_ms"], "close": fresh["close"]})


def append_newer(bars: DataFrame, path: str, checkpoint: str):
    """Appends streamed bars (symbol, ts_ms, close) that are strictly newer than what their symbol has; not started.

    The last bar of a symbol is state, so the sink is never read.  Each micro-batch is a folder of its own by its id, which
    a replay after a failure writes anew: it adds nothing twice.
    """
    fresh = bars.select("symbol", "ts_ms", "close").groupBy("symbol")
    fresh = fresh.transformWithStateInPandas(Newest(), "symbol string, ts_ms long, close double", "append", "none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
