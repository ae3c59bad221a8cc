"""Causal indicators of one symbol's bars, as windows over (symbol, ts_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.folds import ema, recurrence
from tidebar.functions.prices import log_ratio


def by():
    return W.partitionBy("symbol").orderBy("ts_ms")


def rows(first: int, last: int):
    return by().rowsBetween(first, last)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def index() -> Column:
    """A bar's place in its symbol, from 0; warm-up thresholds are places, not frame sizes."""
    return F.row_number().over(by()) - 1


def log_return(column: str = "close") -> Column:
    """Null after or at a price that is not above 0."""
    return log_ratio(F.col(column), F.lag(column).over(by()))


def with_log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_return", F.coalesce(log_return(), F.lit(0.0)))


def differences(column: str = "close") -> Column:
    """The change from the bar before; before the first bar there was 100."""
    return F.col(column) - F.lag(column, 1, 100.0).over(by())


def expanding_range() -> Column:
    """(highest high - lowest low so far) / close."""
    whole = by().rowsBetween(W.unboundedPreceding, 0)
    return F.try_divide(F.max("high").over(whole) - F.min("low").over(whole), F.col("close"))


def price_normals() -> Column:
    least = F.min("close").over(W.partitionBy("symbol"))
    return F.try_divide(F.col("close") - least, least)


def momentum(bars: DataFrame) -> DataFrame:
    """mom_5, mom_60, mom_120, mom_accel, rsi, trend_strength, range_pos, stoch_k, zscore, vol_adj_mom, efficiency."""
    p = F.col("close")
    found = bars.withColumn("_i", index()).withColumn("_d", p - F.lag("close").over(by()))
    back = lambda k, bound: F.when(F.col("_i") >= k, clamp(F.try_divide(p, F.lag("close", k).over(by())) - 1, -bound, bound)).otherwise(0.0)
    found = found.withColumns({"mom_5": back(5, 0.5), "mom_60": back(60, 1.0), "mom_120": back(120, 2.0)})
    accel = clamp(F.col("mom_5") - F.lag("mom_5", 5).over(by()), -0.2, 0.2)
    up, down = F.greatest("_d", F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    f14, f20 = rows(-13, 0), rows(-19, 0)
    gains, losses = F.sum(up).over(f14), F.greatest(F.sum(down).over(f14), F.lit(1e-10))
    ups = F.sum((F.col("_d") > 0).cast("int")).over(f14)
    downs = F.sum((F.col("_d") < 0).cast("int")).over(f14)
    high, low = F.max("close").over(f20), F.min("close").over(f20)
    place = (p - low) / F.greatest(high - low, F.lit(1e-10))
    mean, sd = F.avg("close").over(f20), F.stddev_pop("close").over(f20)
    floored = F.greatest(sd, F.lit(1e-10))
    ago = F.lag("close", 20).over(by())
    path = F.greatest(F.sum(F.abs("_d")).over(f20), F.lit(1e-10))
    late = lambda k, x, default: F.when(F.col("_i") >= k, x).otherwise(default)
    return found.withColumns(
        {
            "mom_accel": late(10, accel, 0.0),
            "rsi": late(14, 1 - 1 / (1 + gains / losses), 0.5),
            "trend_strength": late(14, F.greatest(ups, downs) / 14, 0.0),
            "range_pos": late(20, place * 2 - 1, 0.0),
            "stoch_k": late(20, place, 0.5),
            "zscore": late(20, clamp((p - mean) / floored, -3.0, 3.0), 0.0),
            "vol_adj_mom": late(20, clamp((F.try_divide(p, ago) - 1) / F.greatest(F.try_divide(floored, mean), F.lit(1e-10)), -5.0, 5.0), 0.0),
            "efficiency": late(20, clamp(F.abs(p - ago) / path, 0.0, 1.0), 0.0),
        }
    ).drop("_i", "_d")


def macd(bars: DataFrame, fast: float = 2 / 13, slow: float = 2 / 27) -> DataFrame:
    """Difference of two exponential means in percent of price, at most 5; 0 at the first bar."""
    found = ema(bars, "close", {"_fast": fast, "_slow": slow})
    value = clamp(F.try_divide(F.col("_fast") - F.col("_slow"), F.col("close")) * 100, -5.0, 5.0)
    return found.withColumn("macd", F.when(index() > 0, value).otherwise(0.0)).drop("_fast", "_slow")


def macd_plain(bars: DataFrame) -> DataFrame:
    """Difference of the exponential means with weights 1/12 and 1/26."""
    found = ema(bars, "close", {"_fast": 1 / 12, "_slow": 1 / 26})
    return found.withColumn("macd_plain", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def rsi_ema(bars: DataFrame, alpha: float = 1 / 14) -> DataFrame:
    """100 * up / (up + down) of exponential means of gains and losses; the first difference counts as 1."""
    first = F.lag("close").over(by()).isNull()
    d = F.when(first, 1.0).otherwise(differences())
    found = bars.withColumn("_up", F.greatest(d, F.lit(0.0))).withColumn("_down", F.greatest(-d, F.lit(0.0)))
    found = ema(found, "_up", {"_gain": alpha})
    found = ema(found, "_down", {"_loss": alpha})
    share = F.try_divide(F.col("_gain"), F.col("_gain") + F.col("_loss"))
    return found.withColumn("rsi_percent", share).withColumn("rsi_ema", share * 100).drop("_up", "_down", "_gain", "_loss")


def rolling_volatility(bars: DataFrame, width: int = 20, per_year: float = 252 * 78) -> DataFrame:
    """Annualised percent volatility of the log returns of the ``width`` prices before a bar; null while warming up."""
    found = bars.withColumn("_r", log_return())
    sd = F.stddev_pop("_r").over(rows(-(width - 1), -1))
    value = F.when(index() >= width, sd * F.sqrt(F.lit(per_year)) * 100)
    return found.withColumn("rolling_vol", value).drop("_r")


def rolling_sharpe(bars: DataFrame, width: int = 100, per_year: float = 252 * 78) -> DataFrame:
    """Annualised mean over deviation of the log returns among the ``width`` prices before a bar, and their drawdown."""
    before = rows(-(width - 1), -1)
    found = bars.withColumn("_r", log_return()).withColumn("_i", index())
    mean, sd = F.avg("_r").over(before), F.stddev_pop("_r").over(before)
    sharpe = F.when(sd > 1e-10, mean / sd * F.sqrt(F.lit(per_year))).otherwise(0.0)
    prices = F.collect_list("close").over(rows(-width, -1))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    step = lambda a, x: F.struct(
        F.greatest(a["peak"], x).alias("peak"),
        F.greatest(a["worst"], 1 - F.try_divide(x, F.greatest(a["peak"], x))).alias("worst"),
    )
    drawdown = F.aggregate(prices, start, step, lambda a: a["worst"])
    late = F.col("_i") >= width
    return found.withColumns({"rolling_sharpe": F.when(late, sharpe), "rolling_drawdown": F.when(late, drawdown)}).drop("_r", "_i")


def drawdown(bars: DataFrame, column: str = "close") -> DataFrame:
    """Running peak and the fall from it."""
    peak = F.max(column).over(by().rowsBetween(W.unboundedPreceding, 0))
    return bars.withColumn("peak", peak).withColumn("drawdown", 1 - F.try_divide(F.col(column), peak))


def volume_reference(bars: DataFrame, span: int = 20) -> DataFrame:
    """Adds ema_volume: the exponential mean of the volumes before each bar; the first bar has its own."""
    found = ema(bars, "volume", {"_after": 2 / (span + 1)})
    return found.withColumn("ema_volume", F.coalesce(F.lag("_after").over(by()), F.col("volume"))).drop("_after")


def windowed_reference(bars: DataFrame, length: int, warm: int = 256, span: int = 20) -> DataFrame:
    """Adds window, i and ema_volume: ``volume_reference`` seeded anew ``warm`` + 1 bars before each window of ``length`` bars.

    A symbol's first bar has no predecessor and is in no window.  A bar is also warm-up to the few windows that begin
    within the next ``warm`` + 1 bars, so windows are folds of their own, of bounded length, and a long symbol takes many
    tasks.
    """
    i = F.row_number().over(by()) - 1
    own = bars.withColumn("i", i.cast("long"))
    first, last = F.greatest(F.floor((F.col("i") - 1) / length), F.lit(0)), F.floor((F.col("i") + warm) / length)
    each = own.withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    alpha, at = 2 / (span + 1), W.partitionBy("symbol", "window").orderBy("i")
    each = each.withColumn("_a", F.lit(1 - alpha)).withColumn("_b", F.when(F.lag("i").over(at).isNull(), F.col("volume")).otherwise(F.col("volume") * alpha))
    found = recurrence(each, ["symbol", "window"], [F.col("i")], {"_after": ("_a", "_b")})
    found = found.withColumn("ema_volume", F.lag("_after").over(at)).drop("_a", "_b", "_after")
    return found.where(F.col("i") >= F.col("window") * length + 1)


def gae(steps: DataFrame, gamma: float = 0.995, trace: float = 0.95) -> DataFrame:
    """Generalised advantages of (env, t, reward, value, next_value, terminated, truncated), from the last step back.

    A terminated step does not look ahead; a truncated one does, but ends the trace.
    """
    alive = F.when(F.col("terminated"), 0.0).otherwise(1.0)
    goes_on = F.when(F.col("terminated") | F.col("truncated"), 0.0).otherwise(1.0)
    delta = F.col("reward") + gamma * alive * F.col("next_value") - F.col("value")
    found = steps.withColumn("_a", gamma * trace * goes_on).withColumn("_b", delta)
    found = recurrence(found, ["env"], [F.col("t").desc()], {"advantage": ("_a", "_b")}).drop("_a", "_b")
    return found.withColumn("value_target", F.col("advantage") + F.col("value"))
