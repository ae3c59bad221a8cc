"""All three books of ``book_weights``, the dollar-neutral one too, which the query left out."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from tidebar.operators import panel as N
from tidebar.plans import load

QUERIES, SQL = load()
SMALL = "/root/testdata/sf0.001"


def against_sql(spark, sf):
    base = duckdb.connect()
    base.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    cols = ["t", "symbol", "long_only", "signed", "neutral"]
    rows = QUERIES["book_weights"](spark, sf).select(*cols).collect()
    want = base.sql(f"SELECT {', '.join(cols)} FROM ({SQL['book_weights']})").fetchall()
    plain = lambda row: [x + 0.0 if isinstance(x, float) else x for x in row]
    assert sorted(map(plain, rows)) == sorted(map(plain, want)) and want
    return rows


def test_neutral_book_is_returned(spark):
    net, gross = {}, {}
    for r in against_sql(spark, SMALL):
        net[r.t] = net.get(r.t, 0.0) + r.neutral
        gross[r.t] = gross.get(r.t, 0.0) + abs(r.neutral)
    assert all(abs(x) < 1e-5 for x in net.values())
    assert {round(x, 4) for x in gross.values()} == {0.0, 1.0}


@pytest.fixture(scope="module")
def equal(spark, tmp_path_factory):
    """Names that move alike in the first hours, and apart in the last ten."""
    root = str(tmp_path_factory.mktemp("equal"))
    rows = [
        (h * 10 + k, dt.datetime(2024, 1, 6) + dt.timedelta(hours=h), 1, f"s{k}", 10 + h * 37 % 101 * 0.37 + (k * k % 7 * h * 0.01 if h >= 70 else 0), None)
        for h in range(80) for k in range(5)
    ]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{root}/written")
    os.rename(glob.glob(f"{root}/written/*.parquet")[0], f"{root}/events.parquet")
    return root


def test_names_that_move_alike_hold_no_neutral_book(spark, equal):
    rows = against_sql(spark, equal)
    assert all(r.neutral == 0 for r in rows if r.t <= 70) and any(r.neutral for r in rows if r.t > 70)


def test_equal_scores_hold_no_neutral_book(spark):
    rows = [(t, f"s{k}", 0.1 * t) for t in range(1, 12) for k in range(t)]
    found = N.book_weights(spark.createDataFrame(rows, "t long, symbol string, score double"), "score").collect()
    assert len(found) == len(rows) and {r.neutral for r in found} == {0.0}
    assert all(r.signed == pytest.approx(1 / r.t) for r in found)
