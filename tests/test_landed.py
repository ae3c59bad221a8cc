"""Queries on landed documents, appended tables and reports agree with their SQL on the small tables."""

import duckdb
import pytest

from tidebar.plans import load

NAMES = (
    "aggregate_bars", "fetched_history", "series_observations", "usable_bars", "appended_bars", "covered_symbols", "feed_health", "pmf_scores",
    "price_scales", "report_files", "identity_history", "split_like_moves", "common_symbols", "rollout_report", "fitted_support",
)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, name):
    queries, sql = load()
    found = queries[name](spark, SF)
    columns = sorted(found.columns)
    with duckdb.connect() as con:
        for table in ("events", "orders", "lineitem", "part"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.sql(sql[name])
        assert sorted(want.columns) == columns
        want = want.select(", ".join(columns)).fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
