"""Books by blocks: ticks packed before the stateful step, state by book, nulls among them."""

import pyarrow as pa

from tests.test_books import SYMBOLS, TICK, expected, run, sliced, some_ticks
from tidebar.streaming import books as B


def packed(rows, blocks=1):
    """The arrays of a micro-batch as pandas has them."""
    own = pa.Table.from_pylist([dict(zip(B.TICK, r, strict=True)) | {"block": sum(map(ord, r[0] or "")) % blocks} for r in rows])
    return list(B._packed(iter(own.to_batches(max_chunksize=7)), rows=50))


class Held:
    def __init__(self, name, touched):
        self.name, self.touched, self.value = name, touched, {}

    def getValue(self, key):  # noqa: N802
        self.touched.append(("get", self.name, key))
        return self.value.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.touched.append(("update", self.name, key))
        self.value[key] = value


class Handle:
    def __init__(self):
        self.touched = []

    def getMapState(self, name, key, value):  # noqa: N802
        return Held(name, self.touched)


def test_ticks_are_packed_to_a_row_a_block_with_nulls_kept():
    rows = [("x", None, 4, None, None), (None, "a", 3, 60, 2.0), *some_ticks()]
    found = packed(rows, blocks=3)
    assert sum(b.num_rows for b in found) <= 3 * (len(rows) // 50 + 1) < len(rows) / 4
    back = [x for b in found for r in b.to_pylist() for x in zip(*(r[c] for c in B.TICK), strict=True)]
    assert sorted(map(repr, back)) == sorted(map(repr, rows))
    assert not list(B._packed(iter([])))


def test_a_block_of_books_gives_one_frame_and_touches_a_book_once():
    handle, blocks = Handle(), B.Blocks(tuple(SYMBOLS), 60, 2)
    blocks.init(handle)
    rows, found = some_ticks(), []
    for k in range(0, len(rows), 65):
        del handle.touched[:]
        own = rows[k : k + 65]
        frames = list(blocks.handleInputRows((0,), iter(b.to_pandas() for b in packed(own)), None))
        assert len(frames) == 1
        found += [tuple(r.values()) for r in pa.RecordBatch.from_pandas(frames[0], preserve_index=False).to_pylist()]
        assert sorted(x for x in handle.touched if x[1] == "book") == sorted((t, "book", (b,)) for t in ("get", "update") for b in {r[0] for r in own})
    assert sorted(map(repr, found)) == expected(rows, 60, 2)


def test_no_time_and_no_book(spark, tmp_path):
    """A tick without a time changes nothing unless it is invalid; ticks without a book have one of their own."""
    rows, root = some_ticks(), str(tmp_path)
    own = [(None if b == "y" else b, *x) for b, *x in rows]
    odd = [("x", "a", 1000, None, 3.0), ("x", "zz", 1001, None, 3.0), ("z", "a", 1002, None, None), ("z", "a", 1003, None, 1.0)]
    stream = sliced(spark, [*own[:100], *odd[:2], *own[100:], *odd[2:]], TICK, f"{root}/in", [0, 150, 264])
    run(spark, B.frames(stream, SYMBOLS, 60, ring=2, blocks=2), root)
    found = spark.read.schema(B.FRAMES).parquet(f"{root}/out").drop("n").collect()
    more = [("x", 1001, "invalid", None, None, "zz", 3.0, None, None, None), ("z", 1002, "invalid", None, None, "a", None, None, None, None)]
    assert sorted(repr(tuple(r)) for r in found) == sorted([*expected(own, 60, 2), *map(repr, more)])
