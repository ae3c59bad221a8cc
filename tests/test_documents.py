"""Documents with a version, runs, last lines, days stamped across changes of the clock, supports of continuous columns."""

import datetime
import math

import numpy as np
import pytest

from tidebar.operators import reports as R
from tidebar.operators import support as B
from tidebar.sources import providers as P

SCORES = "symbol string, score double"


def test_scores_round_trip_and_are_gated(spark, tmp_path):
    rows = [("a", 1.5), ("b", float("nan")), ("c", float("inf")), ("d", float("-inf")), (None, None), ("é\n\"", -0.0)]
    R.write_scores(spark.createDataFrame(rows, SCORES), f"{tmp_path}/one")
    found = {r.symbol: r.score for r in R.read_scores(spark, f"{tmp_path}/one", SCORES).collect()}
    assert math.isnan(found.pop("b")) and found == {k: v for k, v in rows if k != "b"}
    with pytest.raises(ValueError, match="format version 3, not 4"):
        R.read_scores(spark, f"{tmp_path}/one", SCORES, version=4)
    R.write_scores(spark.createDataFrame(rows[:1], SCORES), f"{tmp_path}/mixed", version=2)
    spark.read.text(f"{tmp_path}/one").write.mode("append").text(f"{tmp_path}/mixed")
    with pytest.raises(ValueError, match="format version"):
        R.read_scores(spark, f"{tmp_path}/mixed", SCORES)
    R.write_scores(spark.createDataFrame([], SCORES), f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no windows"):
        R.read_scores(spark, f"{tmp_path}/none", SCORES)
    spark.createDataFrame([('{"symbol": "a", "score": 1.0}',)], "value string").write.text(f"{tmp_path}/unversioned")
    with pytest.raises(ValueError, match="format version"):
        R.read_scores(spark, f"{tmp_path}/unversioned", SCORES)
    with pytest.raises(ValueError, match="own"):
        R.write_scores(spark.createDataFrame([(1,)], "format_version int"), f"{tmp_path}/clash")


def test_newest_run_with_data(spark):
    rows = [("r1", 5, True, 0), ("r2", 3, False, 4), ("r3", 3, False, 1), ("r4", 9, False, 0), ("r5", None, None, 7)]
    runs = spark.createDataFrame(rows, "name string, touched int, latest boolean, generations int")
    assert [r.name for r in R.newest_with_data(runs).collect()] == ["r3"]
    assert [r.name for r in R.newest_with_data(runs.union(spark.createDataFrame([("r0", 1, True, 1)], runs.schema))).collect()] == ["r0"]
    assert R.newest_with_data(runs.where("generations = 0")).collect() == []


def test_last_lines(spark):
    lines = spark.createDataFrame([(k, f"l{k}") for k in range(50)], "nth long, line string").repartition(4)
    assert [r.line for r in R.last_lines(lines, 3).collect()] == ["l47", "l48", "l49"] and R.last_lines(lines, 99).count() == 50


def test_days_open_at_midnight_in_new_york(spark):
    day = datetime.date.fromisoformat
    hours = {"2024-03-10": 5, "2024-03-11": 4, "2024-11-03": 4, "2024-11-04": 5, "2001-04-01": 5, "2001-04-02": 4}
    rows = [("A", day(d), 1.0, 2.0, 0.5, 1.5, 10.0) for d in hours] + [("A", day("2024-03-10"), 9.0, 9.0, 9.0, 9.0, 1.0)]
    found = P.grouped_daily(spark.createDataFrame(rows, "T string, day date, o double, h double, l double, c double, v double")).collect()
    midnight = lambda d: int(datetime.datetime.fromisoformat(d).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert {r.ts_ms for r in found} == {midnight(d) + h * 3_600_000 for d, h in hours.items()} and len(found) == 6
    assert {r.open for r in found} == {1.0}


def test_support_of_a_continuous_column(spark):
    rng = np.random.default_rng(1)
    x = np.r_[np.zeros(300), np.full(40, 0.25), rng.normal(size=3000)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5)
    found = B.fit_support(df, "x", (0.0,), 16).collect()
    atoms = {r.at: r.mass for r in found if r.kind == "atom"}
    assert atoms == {0.0: pytest.approx(300 / 3340), 0.25: pytest.approx(40 / 3340)}
    rest = np.sort(x[340:])
    share = np.arange(1, 3001) / 3000
    kept = (share >= 1e-4) & (share <= 1 - 1e-4)
    slot = np.floor(share * 15)
    want = sorted(rest[kept & (slot == k)].min() for k in np.unique(slot[kept]))
    assert np.allclose(sorted(r.at for r in found if r.kind == "edge"), want)
    assert B.fit_support(df.limit(0), "x", (0.0,), 16).collect() == []


def brute_bins(xs, mandated, bins, least_mass=0.005, most=8, clip=1e-4):
    xs = sorted(float(np.float32(v)) for v in xs if v is not None and math.isfinite(v))
    n = len(xs)
    count = {v: xs.count(v) for v in set(xs)}
    heavy = sorted((-c, v) for v, c in count.items() if c / n >= least_mass and v not in mandated)
    atoms = sorted({*mandated, *(v for _, v in heavy[: most - len(mandated)])})
    low, high = xs[int(clip * (n - 1) + 0.5)], xs[int((1 - clip) * (n - 1) + 0.5)]
    pins = set(atoms) | ({low} if not atoms or low < atoms[0] else set()) | ({high} if not atoms or high > atoms[-1] else set())
    pins = sorted(pins)
    if len(pins) == 1:
        pins.append(float(np.float32(pins[0] + max(abs(pins[0]), 1) * 1e-3)))
    parts = [[v for v in xs if a < v < b] for a, b in zip(pins, pins[1:])]
    share = B.shared_out([len(p) for p in parts], bins - len(atoms))
    out = []
    for k, pin in enumerate(pins):
        if pin in atoms:
            out.append((pin, pin))
        if k < len(parts):
            values, edges, before = sorted(set(parts[k])), [pin], int(pin not in atoms) - 1
            last = len(values) - 1 - int(pins[k + 1] not in atoms)
            for j in range(1, share[k]) if parts[k] else ():
                goal = math.ceil(j / share[k] * len(parts[k]))
                at = max(next(i for i, v in enumerate(values) if sum(y <= v for y in parts[k]) >= goal), before + 1)
                if at > last:
                    break
                edges.append(values[at])
                before = at
            edges = B.widened([*edges, pins[k + 1]], share[k])
            out += zip(edges, edges[1:])
    return out


@pytest.mark.parametrize("case", ["mixed", "few", "one", "plain", "inside"])
def test_support_bins(spark, case):
    rng = np.random.default_rng(6)
    x = {
        "mixed": [*np.round(rng.normal(size=400), 2), *np.zeros(30), *np.full(9, 1.25)], "few": [-1.0, 0.0, 0.0, 2.0, 3.0], "one": [2.5] * 4,
        "plain": list(rng.exponential(size=500)), "inside": [*rng.uniform(0.1, 0.9, 200), 0.5, 0.5, 1.0],
    }[case]
    mandated = {"mixed": (0.0,), "inside": (0.0, 0.5, 1.0)}.get(case, ())
    least = 0.6 if case in ("few", "plain") else 0.01
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(3)
    found = B.support_bins(df, "x", mandated, 24, least)
    assert found == brute_bins(x, mandated, 24, least) and len(found) == 24
    assert all(a <= b for a, b in found) and all(p[1] == q[0] for p, q in zip(found, found[1:]))


def test_support_bins_of_nothing_and_float_places(spark):
    assert B.support_bins(spark.createDataFrame([(None,)], "x double"), "x", (0.0,)) == []
    values = [-3e38, -1.5, -1e-45, 0.0, 1e-45, 7.25, 3e38]
    assert sorted(values, key=B.float_place) == values and all(B.float_at(B.float_place(v)) == np.float32(v) for v in values)
    assert B.shared_out([10, 0, 10], 8) == [4, 1, 3] or B.shared_out([10, 0, 10], 8) == [3, 1, 4]
    with pytest.raises(ValueError, match="fewer"):
        B.shared_out([1, 1], 1)
