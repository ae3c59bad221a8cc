"""Metrics of a book, seams, windows with their own warm-up, restricted universes, sorts and calendars on awkward rows."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import calendar as K
from tidebar.operators import accounts as A
from tidebar.operators import factors as X
from tidebar.operators import momentum as M
from tidebar.operators import universe as U

DAY = 86_400_000


def test_book_metrics(spark):
    rng = random.Random(5)
    rows = [(t, t * DAY // 4, s, rng.uniform(-0.5, 0.5), rng.gauss(0, 0.05), rng.choice([50.0, None, 0.0]), rng.choice([0.2, float("nan")])) for t in range(40) for s in "abc" if rng.random() < 0.9]
    panel = spark.createDataFrame(rows, "t int, ts_ms long, symbol string, w double, realized_r double, adv double, sigma double").repartition(3)
    found = A.book_metrics(panel, "w", 10.0, 4.0, 0.3, band=0.1).first()
    held, payoff, cost, gross, net, turn, names, share, trades, open_, agree = {}, [], [], [], [], [], [], [], [], {}, []
    by_t = {t: {r[2]: r for r in rows if r[0] == t} for t in range(40)}
    known = {}
    for t in range(40):
        c = u = 0.0
        moves = []
        for s in [s for s in held if s not in by_t[t]]:
            moves.append((abs(held.pop(s)), *known[s]))
            if s in open_:
                trades.append(open_.pop(s))
        for s, r in by_t[t].items():
            off = r[3] - held.get(s, 0.0)
            known[s] = r[5], r[6]
            if abs(off) > 0.1:
                moves.append((abs(off), r[5], r[6]))
                held[s] = r[3]
            held.setdefault(s, 0.0)
            if s in open_ and np.sign(held[s]) != open_[s][2]:
                trades.append(open_.pop(s))
            if held[s]:
                n, p, g = open_.get(s, (0, 0.0, np.sign(held[s])))
                open_[s] = (n + 1, p + held[s] * math.expm1(r[4]), g)
                agree.append(np.sign(held[s]) == np.sign(r[4]))
        for m, adv, sigma in moves:
            u += m
            c += m * 4 / 10_000
            if m > 0 and adv and sigma == sigma:
                c += m * 0.3 * sigma * math.sqrt(m * 10 / adv)
                share.append(m * 10 / adv)
        payoff.append(sum(held[s] * math.expm1(r[4]) for s, r in by_t[t].items()))
        cost.append(c), turn.append(u), names.append(len(by_t[t]))
        gross.append(sum(map(abs, held.values()))), net.append(sum(held.values()))
    trades += open_.values()
    r, years = np.array(payoff) - cost, 39 * (DAY // 4) / (365.25 * DAY)
    logs = np.cumsum(np.log1p(r))
    want = {
        "instants": 40, "trading_days": 10, "final_log_wealth": logs[-1], "span_years": years, "cagr": math.expm1(logs[-1] / years), "sharpe": r.mean() / r.std(ddof=1) * math.sqrt(40 / years),
        "max_drawdown": (1 - np.exp(logs - np.maximum(np.maximum.accumulate(logs), 0))).max(), "mean_gross": np.mean(gross), "max_abs_net": np.abs(net).max(), "turnover_per_day": sum(turn) / 10,
        "mean_breadth": np.mean(names), "cost_bps_per_instant": np.mean(cost) * 1e4, "rotation_per_instant": np.mean(turn) / np.mean(gross), "payoff_sd_bps_per_instant": np.std(payoff, ddof=1) * 1e4,
        "trades": len(trades), "mean_hold_bars": np.mean([n for n, _, _ in trades]), "trade_win_rate": np.mean([p > 0 for _, p, _ in trades]), "sign_agreement": np.mean(agree),
        "realized_cost_bps": sum(cost) / sum(turn) * 1e4, "mean_participation": np.mean(share), "max_participation": max(share),
    }
    for name, value in want.items():
        assert found[name] == pytest.approx(value), name


def test_metrics_of_a_book_that_stands_still(spark):
    panel = spark.createDataFrame([(0, 0, "a", 0.0, 0.1, 1.0, 1.0)], "t int, ts_ms long, symbol string, w double, realized_r double, adv double, sigma double")
    found = A.book_metrics(panel, "w", 10.0, 4.0, 0.3).first()
    assert (found["trades"], found["final_wealth"], found["sharpe"], found["calmar"], found["realized_cost_bps"]) == (0, 1.0, None, None, None)


def test_seam_census(spark):
    r = [0.0, math.log(2), 0.0, 1.0, -0.9, 0.01, -math.log(3)]
    rows = [("a", k, [0, 0, 0, 1, 1, 2, 3][k], x, 0.1 if k != 6 else 2.0, 0.1) for k, x in enumerate(r)] + [("b", 0, 0, 1.0, 0.1, 5.0)]
    found = {(e.symbol, e.ts_ms): e for e in X.seam_census(spark.createDataFrame(rows, "symbol string, ts_ms long, day long, r double, s double, w double"), math.log(1.5), 0.5, math.log(2)).collect()}
    assert found.keys() == {("a", 1), ("a", 3), ("a", 4), ("a", 6), ("b", 0)}
    flags = lambda *k: tuple(found[k][c] for c in ("session_open", "quiet", "isolated", "reverts"))
    assert flags("a", 1) == (False, True, True, False) and (found["a", 1].p, found["a", 1].q) == (2, 1) and found["a", 1].off < 1e-12
    assert flags("a", 3) == (True, True, False, True) and flags("a", 4) == (False, True, False, False)
    assert flags("a", 6) == (True, False, True, False) and flags("b", 0) == (False, False, True, False)


def test_windowed_reference(spark):
    rng = random.Random(9)
    volumes = {"a": [rng.uniform(1, 9) for _ in range(95)], "b": [2.0], "c": [3.0, 5.0]}
    bars = spark.createDataFrame([(s, k * 10, v) for s, vs in volumes.items() for k, v in enumerate(vs)], "symbol string, ts_ms long, volume double").repartition(3)
    found = {(r.symbol, r.i): r.ema_volume for r in M.windowed_reference(bars, 8, warm=12).collect()}
    want = {}
    for s, vs in volumes.items():
        for i in range(1, len(vs)):
            anchor = (i - 1) // 8 * 8 + 1
            e = None
            for v in vs[max(anchor - 13, 0) : i]:
                e = v if e is None else e + 2 / 21 * (v - e)
            want[s, i] = e
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_restriction_keeps_the_bounds_of_all(spark):
    bars = spark.createDataFrame([(s, k * 10) for s, n in (("a", 50), ("b", 80), ("few", 3)) for k in range(n)], "symbol string, ts_ms long")
    names = spark.createDataFrame([("a",), ("a",), ("few",), ("unknown",), (None,)], "symbol string")
    whole = {(r.ts_ms, r.split) for r in U.with_split(bars.where("symbol <> 'few'"), U.split_bounds(bars.where("symbol <> 'few'"), 10)).collect()}
    found = U.restricted(bars, 5, 10, names).collect()
    assert {r.symbol for r in found} == {"a"} and len(found) == 50 and {(r.ts_ms, r.split) for r in found} <= whole
    given = spark.createDataFrame([(20, 30)], "b0 long, b1 long")
    assert {r.split for r in U.restricted(bars, 5, 10, names, given).where("ts_ms < 20").collect()} == {"train"}


def test_bounded_reads_reach_the_scan(spark, tmp_path):
    rows = [(s, k * 10, float(k), 1.0) for s in "abc" for k in range(50)]
    spark.createDataFrame(rows, "symbol string, ts_ms long, close double, volume double").write.partitionBy("symbol").parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    plan = bars.where("symbol = 'b' AND ts_ms >= 100 AND ts_ms < 200").select("close")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ms,100)" in plan and "LessThan(ts_ms,200)" in plan
    assert "symbol" in plan.split("PartitionFilters: [")[1].split("]")[0] and "volume" not in plan.split("ReadSchema: ")[1]


def test_liquidity_order(spark):
    rows = [("a", 3.0), ("b", float("nan")), ("c", None), ("d", -1.0), ("e", float("inf")), ("f", 3.0)]
    found = U.by_liquidity(spark.createDataFrame(rows, "symbol string, adv double")).orderBy("rank").collect()
    assert [r.symbol for r in found] == ["b", "c", "e", "d", "a", "f"] and [r["rank"] for r in found] == [1, 2, 3, 4, 5, 6]


def test_yearly_dates_are_strictly_after(spark):
    day = lambda s: datetime.date.fromisoformat(s)
    df = spark.createDataFrame([(day(d),) for d in ("2024-03-14", "2024-03-15", "2024-12-15", "2024-12-31")], "day date")
    found = [(str(r.a), str(r.b)) for r in df.select(K.next_yearly(F.col("day"), K.RATE_MONTHS, K.RATE_DAY).alias("a"), K.next_yearly(F.col("day"), K.PRODUCT_MONTHS, K.PRODUCT_DAY).alias("b")).collect()]
    assert found == [("2024-03-15", "2024-04-28"), ("2024-05-15", "2024-04-28"), ("2025-01-15", "2025-01-28"), ("2025-01-15", "2025-01-28")]


def test_sampled_sessions(spark):
    days = spark.createDataFrame([(datetime.date(2024, 1, 6),), (datetime.date(2024, 1, 16),), (None,)], "day date")
    assert sorted(str(r.day) for r in U.sampled_sessions(days, 3).collect()) == ["2024-01-05", "2024-01-11", "2024-01-16"]
    assert U.sampled_sessions(days.limit(0), 3).collect() == []
