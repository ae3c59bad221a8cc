"""Queries on tables with prices of zero, without a price, and with symbols of one row, held against their SQL."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

from tidebar.functions import calendar as K
from tidebar.plans import load

QUERIES, SQL = load()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The small tables, with more events: zeros, nulls and infinities among others' prices, and lone symbols."""
    root = str(tmp_path_factory.mktemp("awkward"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    day = dt.datetime(2024, 1, 9, 14)
    prices = [0.0, None, math.inf, 5.0, 0.0, 40.0, 7.0, 0.0]
    rows = [(10_000_000 + k, day + dt.timedelta(minutes=20 * k), 3, "view", v, None) for k, v in enumerate(prices)]
    rows += [(20_000_000, day, 999_999, "once", 12.0, None), (20_000_001, day, 999_998, "never", 0.0, None), (20_000_002, day, 999_997, "never", None, None)]
    more = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.unionByName(more.select(*events.columns)).coalesce(1).write.parquet(f"{root}/written")
    os.rename(glob.glob(f"{root}/written/*.parquet")[0], f"{root}/events.parquet")
    for name in os.listdir(SMALL):
        if name != "events.parquet":
            os.symlink(f"{SMALL}/{name}", f"{root}/{name}")
    return root


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(k for k, sql in SQL.items() if "events" in sql))
def test_agrees_with_sql(spark, sf, name):
    base = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(file).split('.')[0]} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    want = base.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(str(plain(tuple(r))) for r in frame.select(*cols).collect()) == sorted(str(plain(r)) for r in want)


def test_sessions(spark):
    """Days of which it is known whether the exchange traded."""
    days = {str(r.day) for r in K.sessions(spark, "1995-01-01", "2025-12-31").collect()}
    traded = ("1995-01-16", "1996-01-15", "1997-01-20", "2021-06-18", "1999-12-31", "2010-12-31")
    shut = ("1998-01-19", "2001-09-11", "2004-06-11", "2012-10-29", "2022-06-20", "2025-01-09", "1997-03-28", "2000-07-04", "2020-12-25")
    assert days.issuperset(traded) and not days.intersection(shut)
    found = duckdb.sql(f"WITH {K.sessions_sql('1995-01-01', '2025-12-31')} SELECT day FROM sessions").fetchall()
    assert {str(d) for (d,) in found} == days
