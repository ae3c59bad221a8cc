"""Provider documents landed as JSON, to rows: charts, aggregates, series of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.calendar import session_open_ms

_NUMBERS = "array<double>"
CHART = f"symbol string, timestamp array<long>, open {_NUMBERS}, high {_NUMBERS}, low {_NUMBERS}, close {_NUMBERS}, volume {_NUMBERS}, adjclose {_NUMBERS}"


def positive(x: Column) -> Column:
    """The value where it is finite and above 0, else null."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def chart_bars(charts: DataFrame, completed_before_s: int, session_s: int = 86_400) -> DataFrame:
    """Daily bars from parallel arrays: complete sessions with positive prices, adjusted for dividends.

    The factor is adjclose / close; where the series is there but a value is missing, the row goes.  High and low
    are widened to hold open and close; of rows at one time the later place wins; vwap is (high + low + close) / 3.
    """
    has_adjusted = F.col("adjclose").isNotNull()
    place = F.posexplode("timestamp").alias("pos", "ts_s")
    rows = charts.select("symbol", has_adjusted.alias("_adj"), *(F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close", "volume", "adjclose")), place)
    at = lambda c: F.get(F.col(f"_{c}"), F.col("pos"))
    rows = rows.select("symbol", "_adj", "pos", "ts_s", *(positive(at(c)).alias(c) for c in ("open", "high", "low", "close", "adjclose")), F.coalesce(at("volume"), F.lit(0.0)).alias("volume"))
    rows = rows.where(F.col("ts_s") + session_s <= completed_before_s).dropna(subset=["open", "high", "low", "close"])
    rows = rows.where("NOT _adj OR adjclose IS NOT NULL")
    f = F.when(F.col("_adj"), F.col("adjclose") / F.col("close")).otherwise(1.0)
    o, c = F.col("open") * f, F.col("close") * f
    high, low = F.greatest(F.col("high") * f, o, c), F.least(F.col("low") * f, o, c)
    last = F.row_number().over(W.partitionBy("symbol", "ts_s").orderBy(F.desc("pos")))
    return rows.withColumn("_k", last).where("_k = 1").select(
        "symbol", (F.col("ts_s") * 1000).alias("ts_ms"), o.alias("open"), high.alias("high"), low.alias("low"), c.alias("close"), "volume",
        ((high + low + c) / 3).alias("vwap"), F.lit(0).cast("long").alias("trades"),
    )


def aggregate_bars(rows: DataFrame) -> DataFrame:
    """Provider aggregates (symbol, t, o, h, l, c, v, vw, n): a missing vw is (h + l + c) / 3, a missing n is 0."""
    return rows.select(
        "symbol", F.col("t").alias("ts_ms"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"),
        F.col("v").alias("volume"), F.coalesce("vw", (F.col("h") + F.col("l") + F.col("c")) / 3).alias("vwap"),
        F.least(F.coalesce("n", F.lit(0)), F.lit(4_294_967_295)).cast("long").alias("trades"),
    )


def history(windows: DataFrame, now_ms: int, res_ms: int) -> DataFrame:
    """Fetched windows put together: one bar a time, no bar that is still open."""
    return windows.dropDuplicates(["symbol", "ts_ms"]).where(F.col("ts_ms") + res_ms <= now_ms)


def observations(raw: DataFrame) -> DataFrame:
    """(series, date, realtime_start, value as text) to (series, period, released, value); what is no number is null."""
    value = F.col("value").try_cast("double")
    return raw.select("series", F.to_date("date").alias("period"), F.to_date("realtime_start").alias("released"), F.when(~F.isnan(value), value).alias("value"))


def check_observations(obs: DataFrame) -> DataFrame:
    """Fails on an empty series, one without any value, or rows without a period; otherwise gives the rows back."""
    bad = obs.groupBy("series").agg(F.count("value").alias("values"), F.count_if(F.isnull("period")).alias("undated"))
    wrong = bad.where("values = 0 OR undated > 0").limit(1).collect()
    if wrong or obs.isEmpty():
        raise ValueError(f"bad series: {wrong[0].series if wrong else 'none'}")
    return obs


def grouped_daily(rows: DataFrame) -> DataFrame:
    """One day's bars of all symbols (T, day, o, h, l, c, v), stamped at their close, as bars stamped at New York's midnight.

    Then ts_ms is a bar's opening instant, from whichever endpoint it came; of bars that a symbol has twice the last by
    volume stays.
    """
    own = rows.select(
        F.col("T").alias("symbol"), session_open_ms(F.col("day")).alias("ts_ms"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.col("c").alias("close"), F.col("v").alias("volume"),
    )
    first = F.row_number().over(W.partitionBy("symbol", "ts_ms").orderBy(F.desc("volume"), "open", "high", "low", "close"))
    return own.withColumn("_k", first).where("_k = 1").drop("_k")
