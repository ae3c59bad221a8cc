"""Registered queries use every row of their tables; gaps come from the fixtures alone."""

import datetime as dt

import pytest

from tidebar.plans import load

QUERIES = load()[0]
MACRO_MONTHS = ((1995, 1), (1995, 2), (1995, 3), (1995, 4), (1995, 5))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Supplier 2 has costs of 1995-04 and 1995-05 only; user 1 signs up at a jump of price, user 2 just jumps."""
    root = str(tmp_path_factory.mktemp("tables"))
    day = lambda text: dt.datetime.fromisoformat(text)
    closes = (("2026-05-21", 1229.0), ("2026-05-22", 1146.0), ("2026-05-26", 62.1), ("2026-05-27", 64.5))
    events = [(10 * u + k, day(d), u, "signup" if (u, k) == (1, 2) else "view", v) for u in (1, 2) for k, (d, v) in enumerate(closes)]
    events += [(100 + k, day("2026-06-01") + dt.timedelta(hours=k), 3, "seven", 10.0 + k) for k in range(7)]
    tables = {
        "supplier": ([(1, "odd", 5), (2, "even", 6)], "s_suppkey long, s_name string, s_nationkey int"),
        "lineitem": (
            [(2, day("1995-04-10"), 0.08, 8.0), (2, day("1995-05-10"), 0.02, 10.0)],
            "l_suppkey long, l_shipdate timestamp_ntz, l_discount double, l_quantity double",
        ),
        "orders": ([(day(f"{y}-{m:02d}-03"), 100.0 * m) for y, m in MACRO_MONTHS], "o_orderdate timestamp_ntz, o_totalprice double"),
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def test_fallback_cost_takes_the_measured_month(spark, sf):
    found = {(r["symbol"], r["month"]): r for r in QUERIES["fallback_cost"](spark, sf).collect()}
    assert (found[2, 23944]["spread"], found[2, 23944]["depth"], found[2, 23944]["source"]) == (2.0, 10.0, "month")
    # a month that was not measured takes the nearest; a supplier without any, the median over all
    assert (found[2, 23950]["spread"], found[2, 23950]["source"]) == (2.0, "month")
    assert (found[1, 23944]["spread"], found[1, 23944]["depth"], found[1, 23944]["source"]) == (5.0, 9.0, "universe")


def test_chart_bars_keeps_every_day(spark, sf):
    found = [r for r in QUERIES["chart_bars"](spark, sf).collect() if r["symbol"] == "seven"]
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in found] == [(5.0, 8.0, 5.0, 8.0, 7.0)]


def test_every_signup_explains_a_jump(spark, sf):
    assert [r["symbol"] for r in QUERIES["seam_scan"](spark, sf).collect()] == ["2"]


def test_truncation_keeps_days_before_an_explained_jump(spark, tmp_path):
    """Six days, a jump in price on the fourth with a signup that day: nothing is cut."""
    rows = [(k + 1, dt.datetime(2026, 5, 4 + k), 1, "signup" if k == 3 else "view", 1000.0 if k < 3 else 60.0) for k in range(6)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["truncate_at_seam"](spark, str(tmp_path)).count() == 6


def test_listed_entries_go_over_delisted_ones(spark, sf):
    found = {r["name"]: (r["nation"], r["listings"]) for r in QUERIES["reference_precedence"](spark, sf).collect()}
    assert found == {"odd": (5, 2), "even": (6, 2)}


def test_macro_has_every_month(spark, sf):
    found = {(r["period"].year, r["period"].month): r["value"] for r in QUERIES["prior_year"](spark, sf).collect()}
    assert found == {(y, m): 100.0 * m for y, m in MACRO_MONTHS}
