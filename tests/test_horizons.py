"""Scans by ranges, joint bootstraps, horizon correlations and laws, pinned windows, first factors of many names."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.folds import recurrence, scanned
from tidebar.operators import factors as A
from tidebar.operators import horizons as Z
from tidebar.operators import skill as S
from tidebar.operators import universe as U


@pytest.fixture
def ranges(spark):
    """As many ranges as shuffle partitions: nothing is put together."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield 7
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("down", [False, True])
def test_a_scan_is_the_fold_and_no_range_has_a_whole_symbol(spark, ranges, down):
    rng = random.Random(3)
    rows = [("hot", t, rng.uniform(-1, 1), rng.gauss(0, 1)) for t in range(700)] + [(f"s{k}", t, 0.9, 1.0) for k in range(5) for t in range(k + 1)]
    df = spark.createDataFrame(rows, "symbol string, t long, a double, b double").repartition(5)
    order = [F.col("t").desc() if down else F.col("t")]
    one = {(r.symbol, r.t): r.y for r in recurrence(df, ["symbol"], order, {"y": ("a", "b")}).collect()}
    found = scanned(df, ["symbol"], order, {"y": ("a", "b")})
    two = {(r.symbol, r.t): r.y for r in found.collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    sizes = [r["count"] for r in df.repartitionByRange("symbol", *order).where("symbol = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 300
    assert scanned(df.limit(0), ["symbol"], order, {"y": ("a", "b")}).collect() == []


def test_joint_bootstrap(spark):
    rng = random.Random(1)
    rows = [(b, g, rng.gauss(g, 1)) for b in range(9) for g in (1, 2) for _ in range(5)] + [(b, 3, 1.0) for b in (0, 1)] + [(4, None, 2.0)]
    df = spark.createDataFrame(rows, "b int, g int, v double").repartition(3)
    run = lambda frame, **k: S.joint_bootstrap(frame, "b", "g", {"s": F.col("v"), "c": F.col("v").isNotNull().cast("long")}, {"mean": F.try_divide(F.col("s"), F.col("c"))}, 100, **k).collect()
    found = {(r.g, r.stat): r for r in run(df)}
    assert found.keys() == {(g, s) for g in (1, 2, 3, None) for s in ("mean", "mean_over_pooled")}
    pooled = found[None, "mean"]
    assert pooled.point == pytest.approx(np.mean([r[2] for r in rows if r[1]] + [2.0])) and pooled.blocks == 9 and pooled.draws == 100
    assert found[1, "mean"].low < found[1, "mean"].point < found[1, "mean"].high
    assert found[3, "mean"].se == 0 and 50 <= found[3, "mean"].draws < 100
    ratio = found[2, "mean_over_pooled"]
    assert ratio.point == pytest.approx(found[2, "mean"].point / pooled.point)
    assert {tuple(r) for r in run(df)} == {tuple(r) for r in found.values()}
    rare = spark.createDataFrame([(b, 1, 1.0) for b in range(9)] + [(0, 2, 1.0)] , "b int, g int, v double")
    rare = {r.g: r for r in S.joint_bootstrap(rare, "b", "g", {"s": F.col("v")}, {"x": F.when(F.col("s") > 2, F.col("s"))}, 100).where("stat = 'x'").collect()}
    assert rare[2].draws < 50 and rare[2].se is None and rare[2].low is None
    alone = {r.g: r for r in run(df.where("b = 0")) if r.stat == "mean"}
    assert alone[1].blocks == 1 and alone[1].se is None and alone[1].point is not None and alone[1].draws == 0
    assert run(df.limit(0)) == []


def brute_correlation(rows):
    x = np.array(rows, float)
    x = x[:, x.std(0) > 0]
    c = np.corrcoef(x.T)
    n = len(c)
    return (c.sum() - n) / (n * n - n)


def test_horizon_correlation(spark):
    rng = np.random.default_rng(2)
    times = [*range(0, 30), *range(40, 47), 60]
    x = rng.normal(size=(len(times), 4)) + rng.normal(size=(len(times), 1))
    rows = [(t, ts * 10, f"s{k}", float(x[t, k])) for t, ts in enumerate(times) for k in range(4)] + [(0, 0, "part", 1.0)]
    panel = spark.createDataFrame(rows, "t int, ts_ms long, symbol string, r double").repartition(3)
    found = {r.horizon: r for r in Z.horizon_correlation(panel, "r", 10, (1, 3, 20, 40)).collect()}
    blocks = [range(3 * k, 3 * k + 3) for k in range(10)] + [range(30 + 3 * k, 33 + 3 * k) for k in range(2)]
    assert (found[3].blocks, found[3].names) == (12, 4) and found[3].mean_correlation == pytest.approx(brute_correlation([x[list(b)].sum(0) for b in blocks]))
    assert found[1].blocks == 38 and found[1].mean_correlation == pytest.approx(brute_correlation(x))
    assert found[20].blocks == 1 and found[20].mean_correlation is None and 40 not in found
    assert Z.horizon_correlation(panel.limit(0), "r", 10).collect() == []


def test_laws_of_sums(spark):
    law = [0.2, 0.5, 0.3]
    df = spark.createDataFrame([("a", -1.0, 1.0, law), ("b", 0.0, 0.5, None), ("c", 0.0, 0.5, [0.0, 0.0]), ("d", 0.0, 1.0, [3.0])], "key string, first double, step double, pmf array<double>")
    found = {r.key: r for r in Z.horizon_laws(df, 5).collect()}
    brute = np.zeros(11)
    for steps in itertools.product(range(3), repeat=5):
        brute[sum(steps)] += math.prod(law[s] for s in steps)
    assert np.allclose(found["a"].pmf, brute, atol=1e-12) and found["a"]["first"] == -5.0
    assert found["b"].pmf == [] and found["c"].pmf == [] and found["d"].pmf == [1.0]
    long = Z.convolved(np.full(128, 1 / 128), 78)
    assert len(long) == 78 * 127 + 1 and abs(long.sum() - 1) < 1e-9 and abs(long @ np.arange(len(long)) - 78 * 63.5) < 1e-6


def test_pinned_windows(spark):
    counts = {"a": 700, "b": 200, "c": 99, "d": 1, "none": 0}
    df = spark.createDataFrame(list(counts.items()), "symbol string, capacity long")
    found = U.pinned(df, 50).orderBy("turn", "draw", "symbol").collect()
    quota = {s: sum(r.symbol == s for r in found) for s in counts}
    assert len(found) == 50 and quota == {"a": 35, "b": 10, "c": 5, "d": 0, "none": 0}
    assert len({(r.symbol, r.place) for r in found}) == 50 and all(0 <= r.place < counts[r.symbol] for r in found)
    assert {r.symbol for r in found[:3]} == {"a", "b", "c"}
    places = sorted(r.place for r in found if r.symbol == "a")
    assert {b - a for a, b in zip(places, places[1:])} == {20}
    assert found == U.pinned(df.repartition(3), 50).orderBy("turn", "draw", "symbol").collect() != U.pinned(df, 50, seed=1).orderBy("turn", "draw", "symbol").collect()
    assert U.pinned(df, 5000).count() == 1000 and U.pinned(df, 0).count() == 0 and U.pinned(df.limit(0), 9).count() == 0


def test_first_factor_of_many_names(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 1)) @ rng.uniform(0.5, 1.5, (1, 2300)) + 0.2 * rng.normal(size=(12, 2300))
    rows = [(t, f"s{k:04d}", float(x[t, k])) for t in range(12) for k in range(2300) if (t + k) % 11] + [(t, "flat", 1.0) for t in range(12)]
    df = spark.createDataFrame(rows, "t long, symbol string, r double")
    loadings, share = A.first_factor(df, "r", rounds=30, settled=1e-9)
    z = np.zeros((12, 2300))
    for k in range(2300):
        there = [t for t in range(12) if (t + k) % 11]
        z[there, k] = (x[there, k] - x[there, k].mean()) / x[there, k].std()
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[0] * np.sign(vt[0].sum())
    assert len(loadings) == 2300 and share == pytest.approx(s[0] ** 2 / (s**2).sum())
    assert np.allclose(loadings.sort_values("symbol")["loading"], v, atol=1e-6)
    assert math.isnan(A.first_factor(df.where("symbol = 'flat'"), "r")[1])
