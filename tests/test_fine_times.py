"""Queries on ticks that only microseconds tell apart, and on those that lie within half a millisecond of a bar's end."""

import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebar.plans import load
from tidebar.sources.views import epoch_ms

QUERIES, SQL = load()
SMALL = "/root/testdata/sf0.001"
NAMES = (
    "aggregate_bars", "align_common_ts", "appended_bars", "appended_stream", "backtest_metrics", "banded_backtest", "book_ledger", "book_metrics",
    "book_participation", "book_weights", "candle_path", "confusion_report", "decile_assign", "decile_edges",
    "committed_frames", "dedup_first", "last_closes", "late_ticks", "live_bars", "usable_bars",
)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("fine"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows, number = [], 10_000_000
    for h in range(60):
        end = dt.datetime(2024, 1, 6) + dt.timedelta(hours=h)
        for k, symbol in enumerate(("click", "error", "purchase", "signup", "view")):
            # ids fall where times rise; the last one belongs to the next bar
            for us in (-900, -800, -501, -400 - k):
                rows.append((number - len(rows), end + dt.timedelta(microseconds=us), 1 + h % 3, symbol, 5.0 + (h * 7 + k * 11 - us) % 50, None))
    more = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.unionByName(more.select(*events.columns)).coalesce(1).write.parquet(f"{root}/written")
    os.rename(glob.glob(f"{root}/written/*.parquet")[0], f"{root}/events.parquet")
    for name in os.listdir(SMALL):
        if name != "events.parquet":
            os.symlink(f"{SMALL}/{name}", f"{root}/{name}")
    return root


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, sf, name):
    base = duckdb.connect()
    base.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    want = base.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    plain = lambda row: str([round(x, 5) + 0.0 if isinstance(x, float) else str(x) for x in row])
    assert sorted(map(plain, frame.select(*cols).collect())) == sorted(map(plain, want)) and want


def test_milliseconds_are_those_of_the_sql(spark):
    micros = [-2500, -1501, -1500, -501, -500, -499, 0, 499, 500, 501, 1500, 1_704_067_200_999_499, 1_704_067_200_999_500]
    found = spark.createDataFrame([(u,) for u in micros], "us long").select(epoch_ms(F.timestamp_add("MICROSECOND", "us", F.expr("TIMESTAMP_NTZ'1970-01-01'"))).alias("ms"))
    assert [r.ms for r in found.collect()] == [duckdb.sql(f"SELECT epoch_ms(make_timestamp({u}))").fetchall()[0][0] for u in micros]
