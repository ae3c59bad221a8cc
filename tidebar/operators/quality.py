"""Data-quality scans: anomalies, seams, discontinuities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.prices import log_ratio
from tidebar.operators.joins import near
from tidebar.operators.momentum import by, index, log_return

DAY_MS = 86_400_000


def usable(bars: DataFrame, completed_before_ms: int, res_ms: int) -> DataFrame:
    """Finite positive prices, and complete by the cutoff."""
    good = F.lit(True)
    for c in ("open", "high", "low", "close"):
        good = good & (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    return bars.where(good & (F.col("ts_ms") + res_ms <= completed_before_ms))


def marked(bars: DataFrame, hole_days: float = 14, jump: float = 2 * 0.6931471805599453) -> DataFrame:
    """Adds i, gap_ms, r, and kind: splice (after a hole), tick (the next bar gives it back), jump, or null."""
    r, later = log_return(), F.lead("close").over(by())
    found = bars.withColumn("i", index()).withColumn("r", r).withColumn("gap_ms", F.col("ts_ms") - F.lag("ts_ms").over(by()))
    found = found.withColumn("_next", log_ratio(later, F.col("close")))
    extreme = F.abs("r") > jump
    back = F.coalesce(F.abs(F.col("r") + F.col("_next")) < 0.5 * F.abs("r"), F.lit(False))
    kind = F.when(extreme & (F.col("gap_ms") >= hole_days * DAY_MS), "splice").when(extreme & back, "tick").when(extreme, "jump")
    return found.withColumn("hole", F.coalesce(F.col("gap_ms") >= hole_days * DAY_MS, F.lit(False))).withColumn("kind", kind).drop("_next")


def census(bars: DataFrame, hole_days: float = 14, jump: float = 2 * 0.6931471805599453) -> DataFrame:
    """Anomalies of each symbol: bars, holes, splices, ticks, jumps, extreme_range; prices not above 0 make none."""
    wide = log_ratio(F.col("high"), F.col("low")) > jump
    count = lambda c: F.count_if(c).alias
    return marked(bars, hole_days, jump).groupBy("symbol").agg(
        F.count("*").alias("bars"), count(F.col("hole"))("holes"), count(F.col("kind") == "splice")("splices"),
        count(F.col("kind") == "tick")("ticks"), count(F.col("kind") == "jump")("jumps"), count(wide)("extreme_range"),
    )


def rates(census: DataFrame) -> DataFrame:
    """Anomalies per ten thousand bars."""
    total = F.col("holes") + F.col("splices") + F.col("ticks") + F.col("jumps") + F.col("extreme_range")
    return census.withColumn("anomalies", total).withColumn("per_10k", total * 10_000 / F.col("bars"))


def discontinuities(bars: DataFrame, gap_days: float = 5, ratio: float = 4.0) -> DataFrame:
    """Bars after a gap of days or a price change beyond 1/ratio..ratio, with the severity of the break."""
    found = bars.withColumn("i", index()).withColumn("gap_ms", F.col("ts_ms") - F.lag("ts_ms").over(by()))
    found = found.withColumn("ratio", F.try_divide(F.col("close"), F.lag("close").over(by())))
    broken = (F.col("gap_ms") >= gap_days * DAY_MS) | (F.col("ratio") > ratio) | (F.col("ratio") < 1 / ratio)
    return found.where(broken).withColumn("severity", F.col("gap_ms") / DAY_MS + F.abs(F.ln("ratio")))


def seams(bars: DataFrame, splits: DataFrame, within: int = 3) -> DataFrame:
    """Extreme moves that are real breaks: not a tick, not the leg back from one, not near a split of the symbol."""
    found = marked(bars)
    recovery = F.coalesce((F.lag("kind").over(by()) == "tick"), F.lit(False))
    found = found.withColumn("_leg", recovery).where("kind IN ('splice', 'jump') AND NOT _leg").drop("_leg")
    dated = found.withColumn("_day", F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int")))
    excused = near(dated.select("symbol", "ts_ms", "_day"), splits, ["symbol"], "_day", "date", within)
    return dated.join(excused, ["symbol", "ts_ms"], "left_anti").drop("_day")


def after_last_seam(bars: DataFrame, seams: DataFrame, least: int = 250) -> DataFrame:
    """The bars from a symbol's last seam on, of symbols with at least so many of them."""
    last = seams.groupBy("symbol").agg(F.max("ts_ms").alias("_from"))
    kept = bars.join(last, "symbol", "left").where("_from IS NULL OR ts_ms >= _from").drop("_from")
    enough = kept.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return kept.join(enough, "symbol", "left_semi").select(*bars.columns)
