"""Path-dependent books: portfolios whose next trade depends on the last, one scenario after the other in a stream.

Each scenario's steps come in order; a step holds all names' signals and prices as arrays, so a task keeps one
account in memory, whatever the number of steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidebar.functions.folds import streamed


@dataclass
class Account:
    """Cash and quantities; trades pay a commission a share and must be worth a least amount."""

    cash: float
    quantities: dict[str, float] = field(default_factory=dict)
    commission: float = 0.0035

    def value(self, prices: dict[str, float]) -> float:
        return self.cash + sum(q * prices.get(s, 0.0) for s, q in self.quantities.items())

    def trade(self, symbol: str, quantity: float, price: float, least: float) -> float:
        """Trades up to a quantity (below 0: sells) and returns what it came to."""
        if quantity > 0:
            quantity = min(quantity, self.cash / (price + self.commission))
        else:
            quantity = -min(-quantity, self.quantities.get(symbol, 0.0))
        if abs(quantity) * price < least:
            return 0.0
        self.cash = max(self.cash - quantity * price - abs(quantity) * self.commission, 0.0)
        self.quantities[symbol] = self.quantities.get(symbol, 0.0) + quantity
        return abs(quantity) * price


def target_weights(scores: dict[str, float], cash_score: float, low: float, high: float) -> dict[str, float] | None:
    """Shares score / (all scores + cash), each clamped; None where there is nothing to share."""
    total = sum(scores.values()) + cash_score
    if total <= 1e-12:
        return None
    return {s: min(max(x / total, low), high) if x > 0 else 0.0 for s, x in scores.items()}


def rebalance(account: Account, weights: dict[str, float], prices: dict[str, float], sell_band: float = 0.006, buy_band: float = 0.0025) -> float:
    """Sells what is too much, then buys the largest deficits first, as far as cash goes; returns the turnover."""
    total, turnover = account.value(prices), 0.0
    least = total / 300
    gap = {s: w * total - account.quantities.get(s, 0.0) * prices[s] for s, w in weights.items() if s in prices}
    for s in sorted(gap):
        if gap[s] < -sell_band * total:
            turnover += account.trade(s, gap[s] / prices[s], prices[s], least)
    for s in sorted(gap, key=lambda s: (-gap[s], s)):
        if gap[s] > buy_band * total:
            turnover += account.trade(s, gap[s] / prices[s], prices[s], least)
    return turnover


_RESULT = StructType(
    [
        StructField("scenario", StringType()), StructField("step", LongType()), StructField("equity", DoubleType()),
        StructField("cash", DoubleType()), StructField("turnover", DoubleType()),
    ]
)


def backtest(steps: DataFrame, cash: float = 10_000.0, cash_score: float = 1.0, low: float = 0.0, high: float = 0.5) -> DataFrame:
    """(scenario, step, symbols, scores, opens, closes) to equity by step.

    The scores of one step are traded at the opens of the next and marked at its closes.
    """

    def run(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        account, signal = state or (Account(cash), None)
        out = []
        for r in rows.itertuples(index=False):
            opens, closes = dict(zip(r.symbols, r.opens, strict=True)), dict(zip(r.symbols, r.closes, strict=True))
            weights = target_weights(signal, cash_score, low, high) if signal else None
            turnover = rebalance(account, weights, opens) if weights else 0.0
            out.append((r.scenario, int(r.step), account.value(closes), account.cash, turnover))
            signal = {s: max(float(x), 0.0) for s, x in zip(r.symbols, r.scores, strict=True)}
        return (account, signal), pd.DataFrame(out, columns=_RESULT.names)

    return streamed(steps, ["scenario"], [F.col("step")], run, _RESULT)


def steps_of(bars: DataFrame, score: Column, scenario: str = "all") -> DataFrame:
    """Bars of all names with a score, as steps of one scenario."""
    row = F.struct("symbol", F.coalesce(score, F.lit(0.0)).alias("score"), "open", "close")
    own = bars.withColumn("_row", row).groupBy("ts_ms").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    pick = lambda c: F.transform("_rows", lambda x: x[c])
    return own.select(
        F.lit(scenario).alias("scenario"), F.col("ts_ms").alias("step"), pick("symbol").alias("symbols"), pick("score").alias("scores"),
        pick("open").alias("opens"), pick("close").alias("closes"),
    )


def pnl_reward(values: DataFrame, key: str = "scenario", order: str = "step", scale: float = 20.0) -> DataFrame:
    """Log return of equity by step, scaled."""
    from pyspark.sql import Window as W

    before = F.lag("equity").over(W.partitionBy(key).orderBy(order))
    return values.withColumn("reward", F.coalesce(F.ln(F.col("equity") / before) * scale, F.lit(0.0)))


def break_even_bps(steps: DataFrame, most: float = 1000.0, rounds: int = 48, bits_a_round: int = 6) -> float:
    """The flat cost at which a book of (gross_r, turnover) no longer grows: 0 if it never does, inf if it always does.

    As exact as ``rounds`` halvings of the span: each job holds 2 ** ``bits_a_round`` - 1 costs against each other in one
    aggregate, of which a row a cost comes back.
    """

    def growth(costs: list[float]) -> list[float]:
        net = 1 + F.col("gross_r") - F.col("turnover") * (F.col("bps") / 10_000)
        tried = steps.select("gross_r", "turnover", F.explode(F.array(*map(F.lit, costs))).alias("bps"))
        found = tried.groupBy("bps").agg(F.sum(F.ln(F.greatest(net, F.lit(1e-12)))).alias("g")).collect()
        by_cost = {r["bps"]: r["g"] or 0.0 for r in found}
        return [by_cost.get(c, 0.0) for c in costs]

    free, dear = growth([0.0, most])
    if free <= 0:
        return 0.0
    if dear > 0:
        return float("inf")
    a, b, parts = 0.0, most, 1 << bits_a_round
    for _ in range(-(-rounds // bits_a_round)):
        costs = [a + (b - a) * k / parts for k in range(parts + 1)]
        inner = growth(costs[1:-1]) if b > a else []
        grows = 0
        while grows < len(inner) and inner[grows] > 0:
            grows += 1
        a, b = costs[grows], costs[grows + 1]
    return (a + b) / 2
