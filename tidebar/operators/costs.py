"""Liquidity and trading costs measured from bars, by symbol and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions import prices as P
from tidebar.operators.momentum import by

DAY_MS = 86_400_000


def month_index(ts_ms: Column) -> Column:
    day = F.date_from_unix_date(F.floor(ts_ms / DAY_MS).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def measured(bars: DataFrame, res_ms: int, per_day: float, least_pairs: int = 64) -> DataFrame:
    """One row a symbol and month, and one a symbol with month null over all of its months.

    Pairs of bars exactly a resolution apart give the spread estimators and count for the first bar's month; a gap
    breaks the chain of returns.  The spread that prices trades is Roll's, of at least ``least_pairs`` pairs; what
    can't be measured is null.
    """
    good = bars.where("low > 0 AND high >= low AND close > 0").withColumn("month", month_index(F.col("ts_ms")))
    lead = lambda c: F.lead(c).over(by())
    paired = (lead("ts_ms") - F.col("ts_ms")) == res_ms
    joined_before = (F.col("ts_ms") - F.lag("ts_ms").over(by())) == res_ms
    c = {k: F.col(k) for k in ("close", "high", "low")}
    own = P.log_ratio(c["close"], F.lag("close").over(by()))
    found = good.withColumns(
        {
            "_alpha": F.when(paired, P.corwin_schultz_alpha(c["high"], c["low"], lead("high"), lead("low"))),
            "_moment": F.when(paired, P.abdi_ranaldo_moment(c["close"], c["high"], c["low"], lead("high"), lead("low"))),
            "_r": F.when(joined_before, own),
            "_next": F.when(paired, P.log_ratio(lead("close"), c["close"])),
            "_dollars": F.when(F.col("vwap") > 0, F.col("vwap")).otherwise(F.col("close")) * F.col("volume"),
            "_day": F.floor(F.col("ts_ms") / DAY_MS),
        }
    ).withColumn("_cross", F.col("_r") * F.col("_next"))
    levels = F.explode(F.array(F.col("month"), F.lit(None).cast("int"))).alias("month")
    both = found.select(*(x for x in found.columns if x != "month"), levels)
    days = both.groupBy("symbol", "month", "_day").agg(F.sum("_dollars").alias("_dollars"))
    daily = days.groupBy("symbol", "month").agg(F.median("_dollars").alias("daily_dollars"), F.count("*").alias("days"))
    sums = both.groupBy("symbol", "month").agg(
        F.count("*").alias("bars"), F.count("_alpha").alias("pairs"), F.avg("_alpha").alias("_alpha"), F.avg("_moment").alias("_moment"),
        F.stddev_samp("_r").alias("_sd"), F.avg("_cross").alias("_roll"), F.count("_cross").alias("roll_pairs"),
        F.sum(F.try_divide(F.lit(1.0), F.col("close"))).alias("_inverse"),
    )
    same = (F.col("a.symbol") == F.col("b.symbol")) & F.col("a.month").eqNullSafe(F.col("b.month"))
    roll = (F.col("_roll") < 0) & (F.col("roll_pairs") >= least_pairs)
    return sums.alias("a").join(daily.alias("b"), same).select(
        "a.symbol", "a.month", "bars", "pairs", "days", "daily_dollars",
        (F.col("_sd") * F.sqrt(F.lit(per_day))).alias("sigma_daily"),
        P.corwin_schultz_spread(F.col("_alpha")).alias("cs_spread"),
        F.when(F.col("_moment") > 0, F.sqrt("_moment")).alias("ar_spread"),
        F.when(roll, 2 * F.sqrt(-F.col("_roll"))).alias("roll_spread"),
        F.try_divide(F.col("bars"), F.col("_inverse")).alias("harmonic_price"),
    )


def deciles(costs: DataFrame, by: str, fields: list[str], k: int = 10) -> DataFrame:
    """Thin to deep: ``k`` slices [d * n / k, (d + 1) * n / k) of the rows ranked by ``by``, with medians."""
    ranked = costs.withColumn("_i", F.row_number().over(W.orderBy(F.col(by).asc_nulls_first(), "symbol")) - 1)
    ranked = ranked.withColumn("_n", F.count("*").over(W.partitionBy()))
    # the largest d with floor(d * n / k) <= i
    d = F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n"))
    return ranked.groupBy(d.cast("int").alias("decile")).agg(F.count("*").alias("symbols"), *(F.median(f).alias(f) for f in fields))


def all_in_bps(spread: Column, sigma_daily: Column, participation: float, k: float = 1.0) -> Column:
    """Half the spread and the impact of a participation, in basis points; null where either is not measured."""
    return spread / 2 * 10_000 + P.impact_bps(k, sigma_daily * 10_000, F.lit(participation))


def capacity(costs: DataFrame, aums: tuple[float, ...]) -> DataFrame:
    """(book, gross, fixed, impact): net(A) = gross - fixed - sqrt(A) * impact for each A, and where it is 0."""
    steps = costs.withColumn("aum", F.explode(F.array(*map(F.lit, aums))))
    room = F.col("gross") - F.col("fixed")
    return steps.withColumn("net", room - F.sqrt("aum") * F.col("impact")).withColumn(
        "capacity", F.when(room <= 0, 0.0).when(F.col("impact") > 0, F.pow(room / F.col("impact"), 2))
    )
