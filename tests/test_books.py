"""Streams of books: the same rows wherever micro-batches are cut, across restarts, and silence without any row."""

import random
import time

import pytest

from tidebar.streaming import books as B

TICK = "book string, symbol string, seq long, ts_s long, close double"
SYMBOLS = ["a", "b", "c"]


def some_ticks():
    rng, rows, at = random.Random(2), [], {"x": 0, "y": 500}
    for seq in range(260):
        book = rng.choice(["x", "y"])
        at[book] += rng.choice([5, 9, 13, 14, 30])
        late = rng.random() < 0.04
        close = rng.choice([None, 0.0, -1.0, float("inf")]) if rng.random() < 0.05 else 10 + rng.random()
        rows.append((book, rng.choice(["a", "b", "c", "zz" if rng.random() < 0.1 else "a"]), seq, at[book] - (200 if late else 0), close))
    return rows


def expected(rows, width, ring):
    known, out = {}, []
    for book, symbol, seq, ts_s, close in rows:
        out += [(book, *x) for x in known.setdefault(book, B.Book(tuple(SYMBOLS), width, ring)).step(seq, symbol, ts_s, close)]
    return sorted(map(repr, out))


def sliced(spark, rows, schema, root, cuts):
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(root)
        time.sleep(0.02 if k + 2 < len(cuts) else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def run(spark, frame, root, mode="append"):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/n={number}")

    with B.state_store(spark):
        q = frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()


@pytest.mark.parametrize("cuts", [[0, 260], [0, 31, 150, 260], list(range(0, 261, 52))])
def test_frames(spark, tmp_path, cuts):
    rows, root = some_ticks(), str(tmp_path)
    stream = sliced(spark, rows, TICK, f"{root}/in", cuts)
    run(spark, B.frames(stream, SYMBOLS, 60, ring=2), root)
    found = spark.read.schema(B.FRAMES).parquet(f"{root}/out").drop("n").collect()
    want = expected(rows, 60, 2)
    assert sorted(repr(tuple(r)) for r in found) == want
    kinds = {r.kind for r in found}
    assert kinds == {"frame", "late", "invalid"} and max(r.ring_n or 0 for r in found) == 2


def test_frames_after_a_restart(spark, tmp_path):
    rows, root = some_ticks(), str(tmp_path)
    run(spark, B.frames(sliced(spark, rows, TICK, f"{root}/in", [0, 90, 120]), SYMBOLS, 60, ring=2), root)
    run(spark, B.frames(sliced(spark, rows, TICK, f"{root}/in", [120, 260]), SYMBOLS, 60, ring=2), root)
    found = spark.read.schema(B.FRAMES).parquet(f"{root}/out").drop("n").collect()
    assert sorted(repr(tuple(r)) for r in found) == expected(rows, 60, 2)


def test_a_book_takes_one_read_and_one_write_of_state():
    """Each is a message to the JVM; the ring is touched by batches with a frame alone."""
    touched = []

    class Held:
        def __init__(self, name):
            self.name, self.value = name, None

        def get(self):
            touched.append(("get", self.name))
            return self.value

        def update(self, value):
            touched.append(("update", self.name))
            self.value = value

        put = update

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Held(name)

        getListState = getValueState  # noqa: N815

    barrier = B.Barrier(tuple(SYMBOLS), 60, 2)
    barrier.init(Handle())
    barrier.deltas.value = []
    rows = [r for r in some_ticks() if r[0] == "x"]
    found, n = [], 0
    for k in range(0, len(rows), 10):
        del touched[:]
        out = list(barrier.handleInputRows(("x",), iter(rows[k : k + 10]), None))
        found += out
        framed = any(r.kind == "frame" for r in out)
        assert [x for x in touched if x[1] == "book"] == [("get", "book"), ("update", "book")]
        assert framed or len(touched) == 2
        n += not framed
    assert sorted(repr(tuple(r)) for r in found) == expected(rows, 60, 2) and n


def test_frames_are_acted_on_once(spark, tmp_path):
    rows = [("x", 1, 10), ("x", 1, 10), ("x", 2, 11), ("y", 1, 5), ("x", 1, 10), ("x", 2, 11), ("x", 4, 13), ("x", 3, 12)]
    root = str(tmp_path)
    schema = "book string, sequence long, bucket long"
    run(spark, B.acted_once(sliced(spark, rows, schema, f"{root}/in", [0, 2, 5, 7, 8])), root)
    found = spark.read.schema(schema).parquet(f"{root}/out").drop("n").collect()
    assert sorted(map(tuple, found)) == [("x", 1, 10), ("x", 2, 11), ("x", 4, 13), ("y", 1, 5)]


def test_appends_only_newer_bars_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 9.0), ("A", 2, 2.0), ("A", 1, 7.0), ("A", 3, 3.0), ("B", 1, 9.0)]
    root, schema = str(tmp_path), "symbol string, ts_ms long, close double"
    stream = sliced(spark, rows, schema, f"{root}/in", [0, 3, 7])
    with B.state_store(spark):
        plan = B.append_newer(stream, f"{root}/out", f"{root}/state")
        plan.trigger(availableNow=True).start().awaitTermination()
        read = lambda: sorted((r.symbol, r.ts_ms, r.close) for r in spark.read.parquet(f"{root}/out").collect())
        assert read() == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("B", 1, 9.0)]
        commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()  # as if the last batch had been written but not committed
        for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}*"):
            crc.unlink()
        B.append_newer(stream, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    assert read() == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("B", 1, 9.0)]


def test_a_silent_symbol_is_reported_without_a_row(spark, tmp_path):
    root, schema, now = str(tmp_path), "symbol string, ts_s long", int(time.time())
    rows = [("ok", now), ("old", now - 900), ("far", now + 900), ("none", None)]
    stream = sliced(spark, rows, schema, f"{root}/in", [0, 4])

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/n={number}")

    with B.state_store(spark):
        q = B.watched(stream, 4_000).writeStream.foreachBatch(write).outputMode("update")
        q = q.option("checkpointLocation", f"{root}/state").trigger(processingTime="500 milliseconds").start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                found = {(r.symbol, r.state) for r in spark.read.schema(B.HEALTH).parquet(f"{root}/out").collect()} if (tmp_path / "out").exists() else set()
                if {("ok", "silent"), ("none", "never started")} <= found:
                    break
        finally:
            q.stop()
    assert {("old", "stale"), ("far", "ahead"), ("none", "starting"), ("ok", "silent"), ("none", "never started")} <= found
