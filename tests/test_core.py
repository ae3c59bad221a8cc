"""Cases with known answers, and laws: no look-ahead, conservation, streams equal tables."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import calendar as K
from tidebar.functions import folds
from tidebar.functions import prices as P
from tidebar.operators import evaluate as V
from tidebar.operators import factors as A
from tidebar.operators import joins as J
from tidebar.operators import momentum as M
from tidebar.operators import panel as N
from tidebar.operators import quality as Q
from tidebar.operators import simulate as X
from tidebar.operators import skill as S
from tidebar.operators import support as B
from tidebar.operators import universe as U
from tidebar.sources import packed, providers
from tidebar.streaming import live

BAR = "symbol string, ts_ms long, open double, high double, low double, close double, volume double, vwap double, trades long"
DAY = 86_400_000


def frame(spark, closes, symbol="A", step=60_000, ranges=None):
    rows = []
    for k, c in enumerate(closes):
        o, h, low = ranges[k] if ranges else (c, c, c)
        rows.append((symbol, k * step, float(o), float(h), float(low), float(c), 1000.0 + k, float(c), 1))
    return spark.createDataFrame(rows, BAR)


def test_alignment(spark):
    rows = [("A", t) for t in (0, 1, 2, 3)] + [("B", t) for t in (0, 2, 3, 4)] + [("C", t) for t in (2, 3, 5)]
    bars = spark.createDataFrame(rows, "symbol string, ts_ms long")
    assert {r.ts_ms for r in J.aligned(bars).collect()} == {2, 3}
    assert J.aligned(bars).count() == 6
    with pytest.raises(ValueError, match="duplicate timestamp"):
        J.aligned(spark.createDataFrame([("A", 0), ("A", 0)], "symbol string, ts_ms long"))
    with pytest.raises(ValueError, match="no timestamps in common"):
        J.aligned(spark.createDataFrame([("A", 0), ("B", 1)], "symbol string, ts_ms long"))
    alone = spark.createDataFrame([("A", 0), ("A", 2), ("A", 5)], "symbol string, ts_ms long")
    assert J.aligned(alone).count() == 3


def test_asof_takes_null_values_and_needs_the_time(spark):
    obs = spark.createDataFrame([("u", 20, 6.0), ("u", 30, None)], "k string, at long, value double")
    bars = spark.createDataFrame([("u", t) for t in (14, 19, 20, 29, 30)] + [("v", 99)], "k string, t long")
    found = {(r.k, r.t): r.value for r in J.asof(bars, obs, ["k"], "t", "at", ["value"]).collect()}
    assert found == {("u", 14): None, ("u", 19): None, ("u", 20): 6.0, ("u", 29): 6.0, ("u", 30): None, ("v", 99): None}


def test_near(spark):
    day = lambda s: datetime.date.fromisoformat(s)
    splits = spark.createDataFrame([("A", day("2008-09-16"))], "symbol string, date date")
    days = spark.createDataFrame([("A", day(d)) for d in ("2008-09-13", "2008-09-19", "2008-09-20", "2008-10-16")], "symbol string, day date")
    found = {str(r.day) for r in J.near(days, splits, ["symbol"], "day", "date", 3).collect()}
    assert found == {"2008-09-13", "2008-09-19"}


def test_tick_and_recovery(spark):
    ranges = [(10, 10.2, 9.9), (10, 10.1, 9.8), (10, 100, 9.9), (10, 10.1, 9.9)]
    bars = frame(spark, [10, 10, 100, 10], step=DAY, ranges=ranges)
    census = Q.census(bars).first()
    assert (census.ticks, census.jumps, census.extreme_range) == (1, 1, 1)
    none = spark.createDataFrame([], "symbol string, date date")
    assert Q.seams(bars, none).count() == 0


def test_jump_seam_and_split(spark):
    bars = frame(spark, [1229, 1146, 62.1, 64.5], step=DAY)
    none = spark.createDataFrame([], "symbol string, date date")
    found = Q.seams(bars, none).collect()
    assert [(r.i, r.kind) for r in found] == [(2, "jump")]
    split = spark.createDataFrame([("A", datetime.date(1970, 1, 2))], "symbol string, date date")
    assert Q.seams(bars, split).count() == 0


def test_truncation_at_the_last_seam(spark):
    bars = frame(spark, [0.375] * 3 + [10.25] * 250, step=DAY)
    none = spark.createDataFrame([], "symbol string, date date")
    kept = Q.after_last_seam(bars, Q.seams(bars, none))
    assert kept.count() == 250
    assert Q.seams(kept, none).count() == 0


def test_liquidity_ranking(spark):
    start = datetime.date(2022, 1, 3)
    rows = [(s, start + datetime.timedelta(25 * k), x) for s, n, x in (("GONE", 4, 40e6), ("THIN", 20, 2e6), ("STUB", 2, 90e6), ("XX", 5, 50e6)) for k in range(n)]
    samples = spark.createDataFrame(rows, "symbol string, session date, dollar_volume double")
    refs = spark.createDataFrame([("GONE", True), ("THIN", False), ("STUB", False)], "symbol string, delisted boolean")
    found = U.rank_liquidity(samples, refs, 3).orderBy("rank").collect()
    assert [(r.symbol, r.sessions, r.median) for r in found] == [("GONE", 4, 40e6), ("THIN", 20, 2e6)]
    assert found[0].last == start + datetime.timedelta(75)
    ladder = {r.floor: (r.symbols, r.delisted) for r in U.ladder(U.rank_liquidity(samples, refs, 3)).collect()}
    assert ladder[1e6] == (2, 1) and ladder[1e7] == (1, 1) and ladder[1e8] == (0, 0)


def test_chart_bars(spark):
    chart = [("A", [1221451200, 1221537600, 1221537600, 1221624000], [10.0, 12.0, 12.2, 1.0], [10.0, 12.0, 12.2, 1.0], [10.0, 12.0, 12.2, 1.0], [10.0, 12.0, 12.2, None], [100.0, 1.0, 2.0, 3.0], [5.0, 6.0, 6.1, None])]
    found = providers.chart_bars(spark.createDataFrame(chart, providers.CHART), 2_000_000_000).orderBy("ts_ms").collect()
    assert [(r.open, r.close, r.volume, r.trades) for r in found] == [(5.0, 5.0, 100.0, 0), (6.1, 6.1, 2.0, 0)]


def test_momentum_is_causal(spark):
    rng = np.random.default_rng(0)
    closes = (100 + np.cumsum(rng.normal(size=160))).tolist()
    columns = ("mom_5", "mom_60", "mom_120", "mom_accel", "rsi", "trend_strength", "range_pos", "stoch_k", "zscore", "vol_adj_mom", "efficiency")
    whole = M.momentum(frame(spark, closes)).orderBy("ts_ms").collect()
    part = M.momentum(frame(spark, closes[:140])).orderBy("ts_ms").collect()
    assert all(a[c] == pytest.approx(b[c], abs=1e-12) for a, b in zip(whole, part, strict=False) for c in columns)
    assert (whole[4].mom_5, whole[13].rsi, whole[19].stoch_k) == (0.0, 0.5, 0.5)
    p = np.array(closes)
    assert whole[150].mom_120 == pytest.approx(np.clip(p[150] / p[30] - 1, -2, 2))
    w = p[131:151]
    assert whole[150].zscore == pytest.approx(np.clip((p[150] - w.mean()) / w.std(), -3, 3))
    assert M.momentum(frame(spark, range(10, 16))).orderBy("ts_ms").collect()[5].mom_5 > 0
    assert M.momentum(frame(spark, range(15, 9, -1))).orderBy("ts_ms").collect()[5].mom_5 < 0


def test_recurrence_and_exponential_means(spark):
    rng = np.random.default_rng(1)
    closes = rng.uniform(1, 9, 500).tolist()
    both = frame(spark, closes).unionByName(frame(spark, closes[::-1], "B"))
    found = folds.ema(both, "close", {"e": 0.3})
    for symbol, xs in (("A", closes), ("B", closes[::-1])):
        e, want = xs[0], []
        for k, x in enumerate(xs):
            e = x if k == 0 else 0.3 * x + 0.7 * e
            want.append(e)
        own = [r.e for r in found.where(F.col("symbol") == symbol).orderBy("ts_ms").collect()]
        assert own == pytest.approx(want)


def test_gae(spark):
    rows = [("e", t, float(t % 3), 0.5 * t, 0.5 * (t + 1), t == 6, t == 3) for t in range(9)]
    steps = spark.createDataFrame(rows, "env string, t long, reward double, value double, next_value double, terminated boolean, truncated boolean")
    want, a = {}, 0.0
    for _, t, r, v, nv, term, trunc in reversed(rows):
        a = r + (0 if term else 0.995 * nv) - v + (0 if term or trunc else 0.995 * 0.95 * a)
        want[t] = a
    assert {r.t: r.advantage for r in M.gae(steps).collect()} == pytest.approx(want)


def test_risk_metrics(spark):
    equity = spark.createDataFrame([("s", 0, 10_000.0), ("s", 1, 9_900.0), ("s", 2, 9_900.0)], "key string, t long, v double")
    found = N.metrics(equity, "key", "t", "v").first()
    assert found.returns == 2 and found.sharpe == pytest.approx(-1.0) and found.max_drawdown == pytest.approx(1.0)


def test_pairwise_correlation_is_the_mean_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    x[:, 1] += x[:, 0]
    rows = [(t, f"s{k}", float(x[t, k])) for t in range(50) for k in range(4)] + [(0, "rare", 1.0)]
    found = N.pairwise_correlation(spark.createDataFrame(rows, "t long, symbol string, r double"), "r").first()
    corr = np.corrcoef(x.T)
    assert found.names == 4 and found.mean_correlation == pytest.approx(corr[np.triu_indices(4, 1)].mean())


def test_auc_and_spearman(spark):
    rng = np.random.default_rng(3)
    mu, r = np.round(rng.normal(size=300), 1), np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(mu, r, strict=True)], "mu double, r double")
    up, down = mu[(r > 0) & (mu != 0)], mu[(r < 0) & (mu != 0)]
    # of directed and moving bars: share of (rise, fall) pairs that are ranked right, ties half
    want = ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))
    n = len(up) + len(down)
    got = S.auc(df).first().auc
    assert got == pytest.approx(0.5 + (want - 0.5) * 1.0, abs=1 / n)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert S.information(df).first().spearman == pytest.approx(np.corrcoef(rank(mu), rank(r))[0, 1])


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(k // 10, float(k % 7)) for k in range(300)], "block long, x double")
    a, b = S.block_bootstrap(df, "block", "x").first(), S.block_bootstrap(df.repartition(5), "block", "x").first()
    assert a == b and a.low < a.mean < a.high
    assert S.block_bootstrap(df.where("block = 0"), "block", "x").first().mean is None


def test_dof_round_trip(spark):
    rows = [(10.0, 11.0, 13.0, 9.0, 12.0, 5.0, 4.0), (10.0, 10.0, 10.0, 10.0, 10.0, 0.0, 4.0), (5.0, 6.0, 6.0, 4.0, 4.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "p double, o double, h double, l double, c double, v double, u double")
    coded = df.withColumns({f"d_{k}": x for k, x in P.dof(*(F.col(c) for c in "pohlcvu")).items()})
    back = coded.withColumns({f"b_{k}": x for k, x in P.undof(F.col("p"), *(F.col(f"d_{c}") for c in "rsuv")).items()})
    for r in back.collect():
        assert (r.b_open, r.b_high, r.b_low, r.b_close) == pytest.approx((r.o, r.h, r.l, r.c))
    assert [r.d_u for r in back.collect()][1] == 0.5


def test_symlog_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 3.5)], "x double")
    for r in df.select("x", P.symexp(P.symlog(F.col("x"))).alias("y")).collect():
        assert r.x == pytest.approx(r.y)


def test_time_ids_over_a_clock_change(spark):
    at = lambda s: int(datetime.datetime.fromisoformat(s + "+00:00").timestamp() * 1000)
    df = spark.createDataFrame([(at("2024-03-08T14:30:00"),), (at("2024-03-11T13:30:00"),)], "ts_ms long")
    found = df.select(*(c.alias(k) for k, c in P.time_ids(F.col("ts_ms")).items())).collect()
    assert [r.et_minute for r in found] == [570, 570] and [r.et_weekday for r in found] == [4, 0]
    assert [r.et_session for r in found] == [2, 2]


def test_calendar(spark):
    years = spark.createDataFrame([(y,) for y in (1961, 2000, 2024, 2025)], "y int")
    assert [str(r[0]) for r in years.select(K.easter(F.col("y"))).collect()] == ["1961-04-02", "2000-04-23", "2024-03-31", "2025-04-20"]
    days = {str(r.day) for r in K.sessions(spark, "2024-01-01", "2024-12-31").collect()}
    assert len(days) == 252
    shut = ("2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25")
    assert not days & set(shut)
    obs = spark.createDataFrame([("2024-03-28",), ("2024-07-02",)], "d string").select(F.to_date("d").alias("released"))
    found = {str(r.released): str(r.available_day) for r in K.available_at(obs, K.sessions(spark, "2024-01-01", "2024-12-31")).collect()}
    assert found == {"2024-03-28": "2024-04-01", "2024-07-02": "2024-07-03"}
    one = spark.createDataFrame([("2024-03-02",)], "d string").select(F.to_date("d").alias("d"))
    assert str(one.select(K.first_friday(F.col("d"))).first()[0]) == "2024-04-05"


def test_packed_files(spark, tmp_path):
    bars = frame(spark, [1.5, 2.5, 3.5], "BRK.B").unionByName(frame(spark, [7.0], "X"))
    for r in packed.packed(bars, 300).collect():
        (tmp_path / r.name).write_bytes(r.content)
    found = packed.read_bars(spark, str(tmp_path)).orderBy("symbol", "ts_ms").collect()
    assert [(r.symbol, r.res_secs, r.close) for r in found] == [("BRK.B", 300, 1.5), ("BRK.B", 300, 2.5), ("BRK.B", 300, 3.5), ("X", 300, 7.0)]
    heads = {r.symbol: (r.bars, r.last_ts_ms) for r in packed.read_headers(spark, str(tmp_path)).collect()}
    assert heads == {"BRK.B": (3, 120_000), "X": (1, 0)}
    names = spark.createDataFrame([("a/BRK.B.300.bars",), ("a/x.0.bars",), ("a/.300.bars",)], "p string")
    assert [tuple(r) for r in names.select(packed.file_symbol(F.col("p")), packed.file_resolution(F.col("p"))).collect()][0] == ("BRK.B", 300)
    good = packed.encode("A", 60, np.zeros(1, packed.RECORD))
    for bad in (b"", good[:-1], b"X" + good[1:], good + b"\0" * 36):
        with pytest.raises(ValueError):
            packed.decode(bad)
    with pytest.raises(ValueError):
        packed.encode("A", 60, np.zeros(2, packed.RECORD))


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "bars")
    own = frame(spark, range(1, 6)).withColumn("res_secs", F.lit(60))
    packed.write_bars(own.where("ts_ms < 180000"), path)
    assert packed.append_bars(spark, path, own) == 2
    assert packed.append_bars(spark, path, own) == 0
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        packed.write_bars(own.unionByName(own), str(tmp_path / "twice"))


def test_live_buckets_and_barrier(spark):
    ticks = [(10, 1.0), (310, 2.0), (605, 3.0), (900, 4.0), (899, 9.0), (3000, 5.0), (3301, float("nan")), (3302, 6.0)]
    _, out = live.fold_ticks(None, ticks, 300)
    assert out[:3] == [(0, 1.0, "bar"), (1, 2.0, "bar"), (2, 3.0, "bar")]
    assert [(b, k) for b, _, k in out[3:]] == [(2, "late"), (11, "invalid"), (10, "bar")]
    rows = [("A", 0, 10.0, "bar"), ("B", 0, 20.0, "bar"), ("A", 1, 11.0, "bar"), ("B", 1, 21.0, "late")]
    found = live.barrier(spark.createDataFrame(rows, live.BUCKETS), 2).collect()
    assert [(r.bucket, r.closes) for r in found] == [(0, {"A": 10.0, "B": 20.0})]
    latest = spark.createDataFrame([("a", 100, 100), ("b", 10, 100), ("c", 100, 10), ("d", 200, 100)], "symbol string, ts_s long, received_s long")
    assert {r.symbol: r.state for r in live.feed_health(latest, 110, 30).collect()} == {"a": "ok", "b": "stale", "c": "silent", "d": "ahead"}


def test_portfolio_rules():
    assert X.target_weights({"a": 3.0, "b": 1.0}, 0.0, 0.0, 0.6) == {"a": 0.6, "b": 0.25}
    assert X.target_weights({"a": 0.0}, 0.0, 0.0, 1.0) is None
    account = X.Account(1000.0)
    turnover = X.rebalance(account, {"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 20.0})
    assert account.cash >= 0 and account.value({"a": 10.0, "b": 20.0}) <= 1000.0
    assert turnover == pytest.approx(1000, rel=0.01)
    assert X.rebalance(account, {"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 20.0}) == 0.0


def test_backtest_streams_like_one_account(spark):
    bars = frame(spark, [10, 11, 12, 11, 13, 12]).unionByName(frame(spark, [20, 19, 21, 22, 20, 23], "B"))
    steps = X.steps_of(bars, F.lit(1.0))
    found = X.backtest(steps).orderBy("step").collect()
    assert found[0].equity == 10_000.0 and found[0].turnover == 0.0 and found[1].turnover > 0
    assert all(r.equity > 0 and math.isfinite(r.equity) for r in found)


def test_break_even(spark):
    steps = spark.createDataFrame([(0.01, 1.0)] * 5, "gross_r double, turnover double")
    assert X.break_even_bps(steps, rounds=30) == pytest.approx(100.0, abs=1e-3)
    assert X.break_even_bps(steps.withColumn("gross_r", F.lit(-0.1))) == 0.0


def test_support_and_scores(spark):
    df = spark.createDataFrame([(0.0,)] * 10 + [(float(k),) for k in range(1, 91)], "x double")
    found = B.fit_support(df, "x", (0.0,), 11).collect()
    atoms = [r.at for r in found if r.kind == "atom"]
    assert 0.0 in atoms and sum(r.mass for r in found) <= 1.0 + 1e-9
    one = spark.createDataFrame([([0.2, 0.3, 0.5], [1.0, 1.0, 1.0], 1, [0.2, 0.3, 0.5])], "p array<double>, w array<double>, b int, q array<double>")
    r = one.select(B.pmf_nll(F.col("p"), F.col("b")).alias("nll"), B.pmf_crps(F.col("p"), F.col("b"), F.col("w")).alias("crps"), B.pmf_kl(F.col("p"), F.col("q")).alias("kl")).first()
    assert r.nll == pytest.approx(-math.log(0.3)) and r.crps == pytest.approx(0.2**2 + 0.5**2) and r.kl == pytest.approx(0.0)


def test_quotas_and_samples(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1)], "symbol string, capacity long")
    assert {r.symbol: r.quota for r in U.quotas(counts, 7).collect()} == {"a": 4, "b": 2, "c": 1}
    bars = frame(spark, range(1, 101))
    sample = U.block_sample(bars, 10, 3)
    assert sample.count() == 30 and sample.select("block").distinct().count() == 3
    assert U.strided(bars, 4, 16).count() == 6


def test_bounds_conserve_bars(spark):
    bars = frame(spark, range(1, 101))
    bounds = U.split_bounds(bars, 60_000)
    parts = {r.split: r["count"] for r in U.with_split(bars, bounds).groupBy("split").count().collect()}
    assert parts == {"train": 80, "val": 10, "test": 10}


def test_identity_cut(spark):
    bars = frame(spark, [10, 10, 50, 50, 9, 9], step=DAY)
    breaks = Q.discontinuities(bars, gap_days=5, ratio=3.0)
    known = spark.createDataFrame([("A", 0, "old"), ("A", 3 * DAY, "new"), ("A", 5 * DAY, "new")], "symbol string, at_ms long, identity string")
    kept = U.identity_cut(bars, breaks, known)
    assert [r.ts_ms // DAY for r in kept.orderBy("ts_ms").collect()] == [2, 3, 4, 5]
    silent = known.where("at_ms > 0")
    assert U.identity_cut(bars, breaks, silent).count() == 6


def test_split_like_moves(spark):
    bars = frame(spark, [100, 101, 50.5, 50, 200, 50, 51], step=DAY)
    found = A.split_like(bars).collect()
    assert [(r.ts_ms // DAY, r.ratio.p, r.ratio.q) for r in found] == [(2, 2, 1)]


def test_first_factor(spark):
    rng = np.random.default_rng(4)
    common = rng.normal(size=60)
    x = common[:, None] + 0.3 * rng.normal(size=(60, 5))
    df = spark.createDataFrame([(t, f"s{k}", float(x[t, k])) for t in range(60) for k in range(5)], "t long, symbol string, r double")
    loadings, share = A.first_factor(df, "r")
    values = np.linalg.eigvalsh(np.corrcoef(x.T))
    assert share == pytest.approx(values[-1] / values.sum()) and (loadings["loading"] > 0).all()


def test_multiplicity_conserves_bars(spark):
    bars = frame(spark, range(1, 31))
    windows = spark.createDataFrame([("A", 0, 10), ("A", 5, 15), ("A", 20, 30)], "symbol string, start long, end long")
    assert {r.covers: r.bars for r in V.multiplicity(windows, bars).collect()} == {1: 20, 2: 5, 0: 5}


def test_paired_refuses_other_runs(spark):
    a = spark.createDataFrame([("w1", "x", 1.0), ("w2", "x", 2.0)], "w string, run string, score double")
    assert V.paired(a, a.withColumn("score", F.lit(0.5)), ["w"], "score", ["run"]).count() == 2
    with pytest.raises(ValueError):
        V.paired(a, a.withColumn("run", F.lit("y")), ["w"], "score", ["run"])
    with pytest.raises(ValueError):
        V.paired(a, a.where("w = 'w1'"), ["w"], "score", ["run"])


def test_common_symbols(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "s int, symbol string")
    assert [r.symbol for r in V.common_symbols(df, "s").collect()] == ["a"]
    with pytest.raises(ValueError):
        V.common_symbols(df.unionByName(df), "s")


def test_band_zero_is_the_window_form(spark):
    rng = np.random.default_rng(6)
    rows = [(t, f"s{k}", float(rng.normal()), float(rng.normal() / 50)) for t in range(20) for k in range(4) if (t + k) % 5]
    panel = N.book_weights(spark.createDataFrame(rows, "t long, symbol string, score double, realized_r double"), "score")
    a = {r.t: (r.gross_r, r.turnover, r.wealth) for r in N.panel_backtest(panel, "signed", 5.0).collect()}
    b = {r.t: (r.gross_r, r.turnover, r.wealth) for r in V.banded_backtest(panel, "signed", 5.0, 0.0).collect()}
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t]) for t in a)


def test_journal_skips_torn_lines(spark):
    lines = [(1, '{"symbol": "A", "n": 1}'), (2, '{"symbol": "A", "n": 2}'), (3, '{"symbol": "A", "n"'), (4, '{"symbol": "B", "n": 5}')]
    found = packed.replay_journal(spark.createDataFrame(lines, "nth long, value string"), "symbol string, n long", ["symbol"])
    assert {(r.symbol, r.n) for r in found.collect()} == {("A", 2), ("B", 5)}
