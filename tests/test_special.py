"""Special functions against closed forms and tabulated values; percentiles by counts; mixtures against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import special as S
from tidebar.functions.shared import percentiles, value_counts
from tidebar.operators import mixtures as X

EULER = 0.577215664901532860606512090082


def test_gamma_family():
    x = np.r_[np.linspace(1e-3, 30, 400), 47.25, 100.0]
    assert np.abs(S.ln_gamma(x) - [math.lgamma(v) for v in x]).max() < 1e-12
    assert abs(S.ln_gamma(1e6) / math.lgamma(1e6) - 1) < 1e-13
    harmonic = lambda n: sum(1 / k for k in range(1, n))
    assert all(abs(S.digamma(n) - (harmonic(n) - EULER)) < 1e-12 for n in (1, 2, 3, 10, 15, 40))
    assert abs(S.digamma(0.5) - (-EULER - 2 * math.log(2))) < 1e-12
    assert abs(S.trigamma(1) - math.pi**2 / 6) < 1e-12 and abs(S.trigamma(0.5) - math.pi**2 / 2) < 1e-12
    assert np.isnan(S.ln_gamma([0, -1, np.nan])).all() and np.isnan(S.digamma([0.0, -2.5])).all()


def test_incomplete_gamma_and_normal_law():
    for n in (1, 2, 5, 30):
        for x in (0.0, 0.1, 1.0, 4.9, 29.0, 31.5, 80.0):
            q = math.exp(-x) * sum(x**k / math.factorial(k) for k in range(n))
            assert abs(S.gamma_q(n, x) - q) < 1e-12 and abs(S.gamma_p(n, x) - (1 - q)) < 1e-12
    z = np.linspace(-26, 26, 1041)
    exact = np.array([math.erfc(v) for v in z])
    assert (np.abs(S.erfc(z) - exact) <= 1e-12 * exact).all()
    assert S.normal_cdf(0) == 0.5 and abs(S.normal_cdf(1.959963984540054) - 0.975) < 1e-14
    assert S.gamma_p(2, np.inf) == 1 and np.isnan(S.gamma_p(2, -1)) and np.isnan(S.gamma_p(0, 1)) and np.isnan(S.erfc(np.nan))
    big = S.gamma_p(1000, np.array([900.0, 1000.0, 1100.0]))
    assert np.abs(big + S.gamma_q(1000, np.array([900.0, 1000.0, 1100.0])) - 1).max() < 1e-12 and abs(big[1] - 0.504204) < 1e-5


def test_columns_give_null_outside_the_domain(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,), (float("nan"),)], "x double")
    found = [r.y for r in df.select(S.column(S.ln_gamma, F.col("x")).alias("y")).collect()]
    assert abs(found[0]) < 1e-12 and found[1:] == [None, None, None]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_percentiles_by_counts(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, rng.random(), None])) for _ in range(400)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    found = {tuple(r[k] for k in keys): r.cuts for r in percentiles(df, "v", qs, keys).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault((k,) if keys else (), []).append(v)
    assert found.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(found[k], np.quantile(v, qs), atol=1e-12)
    counts = value_counts(df, "v", keys).collect()
    assert all(r.below == sum(v < r.v for v in groups[tuple(r[k] for k in keys)]) for r in counts)


def test_percentiles_of_nothing(spark):
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).collect() == []


def test_gaussian_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(-2, 0.5, 300), rng.normal(3, 1.5, 500)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(4)
    start = X.Gaussian.start(df, "x", 2)
    assert np.allclose(start.means, np.quantile(x, [0.25, 0.75])) and np.allclose(start.sds, (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 2)
    law, path = X.fit(df, "x", start)
    assert all(b >= a - 1e-12 for a, b in zip(path, path[1:])) and len(path) < X.ROUNDS
    w, m, s = np.array(start.weights), np.array(start.means), np.array(start.sds)
    for level in path:
        terms = np.log(w)[:, None] - np.log(s)[:, None] - 0.5 * np.log(2 * np.pi) - 0.5 * ((x - m[:, None]) / s[:, None]) ** 2
        ll = np.logaddexp.reduce(terms, 0)
        assert abs(ll.mean() - level) < 1e-10
        share = np.exp(terms - ll)
        w, m = share.mean(1), (share @ x) / share.sum(1)
        s = np.sqrt((share @ x**2) / share.sum(1) - m**2)
    assert np.allclose(law.weights, w) and np.allclose(law.means, m) and np.allclose(law.sds, s)
    assert sorted(np.round(law.means)) == [-2, 3]


def test_beta_mixture(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.beta(2, 9, 400), rng.beta(12, 3, 300)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(0.0,), (1.0,), (None,), (-3.0,)], "x double").repartition(4)
    start = X.Beta.start(df, "x", 2)
    law, path = X.fit(df, "x", start, rounds=60)
    assert all(b >= a - 1e-10 for a, b in zip(path, path[1:]))
    log_b = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    for w, a, b in law.rows():
        assert 0 < w < 1
        terms = [math.log(v) + (p - 1) * np.log(x) + (q - 1) * np.log1p(-x) - log_b(p, q) for v, p, q in law.rows()]
        share = np.exp(math.log(w) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - log_b(a, b) - np.logaddexp.reduce(terms, 0))
        g, h = (share @ np.log(x)) / share.sum(), (share @ np.log1p(-x)) / share.sum()
        assert abs(S.digamma(a) - S.digamma(a + b) - g) < 2e-2 and abs(S.digamma(b) - S.digamma(a + b) - h) < 2e-2
    means = sorted(a / (a + b) for _, a, b in law.rows())
    assert abs(means[0] - 2 / 11) < 0.05 and abs(means[1] - 0.8) < 0.05


def test_no_rows_no_fit(spark):
    none = spark.createDataFrame([], "x double")
    assert X.fit(none, "x", X.Gaussian.start(none, "x", 2)) == (None, [])
    same = spark.createDataFrame([(1.5,)] * 5, "x double")
    law, path = X.fit(same, "x", X.Gaussian.start(same, "x", 2))
    assert all(abs(m - 1.5) < 1e-9 for m in law.means) and all(math.isfinite(v) for v in path)
