"""Point-in-time and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Left rows with ``values`` of the latest right row of the same keys with right_at <= left_at.

    The latest row counts even where its values are null.  Both sides are tagged, united and carried forward by one
    window, so there is one sort and no join; of right rows at one time the greatest values win.
    """
    # rows without an available time, and keys without right rows, are simply never carried
    names = [c for c in left.columns if c not in by]
    a = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_tag"), F.struct(*names).alias("_row"), F.lit(None).alias("_seen"))
    b = right.where(F.col(right_at).isNotNull()).select(
        *by, F.col(right_at).alias("_at"), F.lit(0).alias("_tag"), F.lit(None).alias("_row"), F.struct(*values).alias("_seen")
    )
    order = W.partitionBy(*by).orderBy("_at", "_tag", "_seen").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_seen", ignorenulls=True).over(order))
    return both.where("_tag = 1").select(*by, "_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def asof_days(left: DataFrame, series: DataFrame, left_day: str, out_day: str) -> DataFrame:
    """Left rows with the row of one series that was out last on their day: an equi-join on days.

    A release stands for the days until the next, so the series becomes a row a day, however many rows are on the left;
    of releases of one day the greatest counts.
    """
    values = [c for c in series.columns if c != out_day]
    newest = series.where(F.col(out_day).isNotNull()).groupBy(out_day).agg(F.max(F.struct(*values)).alias("_seen"))
    last = left.agg(F.max(left_day).alias("_last"))
    until = F.coalesce(F.date_sub(F.lead(out_day).over(W.orderBy(out_day)), 1), F.greatest(F.col("_last"), F.col(out_day)))
    newest = newest.join(F.broadcast(last)).withColumn("_until", until)  # one row
    spans = newest.select("_seen", F.explode(F.sequence(F.col(out_day), F.col("_until"))).alias(left_day))
    return left.join(spans, left_day, "left").select(*left.columns, *(F.col(f"_seen.{v}").alias(v) for v in values))


def common_timestamps(bars: DataFrame) -> DataFrame:
    """The bars whose time exists for every symbol."""
    count = bars.select("symbol").distinct().agg(F.count("*").alias("_n"))
    full = bars.groupBy("ts_ms").agg(F.countDistinct("symbol").alias("_have")).join(F.broadcast(count), F.col("_have") == F.col("_n"))
    return bars.join(full.select("ts_ms"), "ts_ms", "left_semi").select(*bars.columns)


def check_series(bars: DataFrame) -> DataFrame:
    """Fails on a symbol with two bars at one time; otherwise gives the bars back."""
    twice = bars.groupBy("symbol", "ts_ms").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate timestamp {twice[0].ts_ms} of {twice[0].symbol}")
    return bars


def aligned(bars: DataFrame) -> DataFrame:
    """``common_timestamps`` with its checks: no duplicates, and something in common."""
    found = common_timestamps(check_series(bars))
    if not bars.isEmpty() and found.isEmpty():
        raise ValueError("no timestamps in common")
    return found


def newer_tail(corpus: DataFrame, tail: DataFrame) -> DataFrame:
    """The corpus and those tail rows that are later than its symbol's last."""
    last = corpus.groupBy("symbol").agg(F.max("ts_ms").alias("_last"))
    newer = tail.join(last, "symbol", "left").where("_last IS NULL OR ts_ms > _last").select(*corpus.columns)
    return corpus.unionByName(newer)


def prior_period(now: DataFrame, releases: DataFrame, months: int = 12) -> DataFrame:
    """(series, period, at) with the first release of the period ``months`` before, if it was out at ``at``."""
    first = releases.groupBy("series", "period").agg(F.min_by(F.struct("value", "available"), "available").alias("r"))
    before = first.select("series", F.add_months("period", months).alias("period"), F.col("r.value").alias("prior_value"), F.col("r.available").alias("_out"))
    return now.join(before, ["series", "period"], "left").withColumn(
        "prior_value", F.when(F.col("_out") <= F.col("at"), F.col("prior_value"))
    ).drop("_out")


def near(left: DataFrame, right: DataFrame, by: list[str], day: str, other_day: str, within: int) -> DataFrame:
    """Left rows with a right row of the same keys at most ``within`` days away.

    Days fall into buckets of ``2 * within + 1``; a right row counts in the two or three buckets that its span
    touches, so this is an equi-join of bounded fan-out.
    """
    width = 2 * within + 1
    bucket = lambda d: F.floor(F.unix_date(d) / width)
    spread = right.select(
        *by, F.col(other_day).alias("_other"),
        F.explode(F.array_distinct(F.array(*(bucket(F.date_add(F.col(other_day), k)) for k in (-within, within))))).alias("_bucket"),
    )
    marked = left.withColumn("_bucket", bucket(F.col(day)))
    close = F.abs(F.datediff(F.col(day), F.col("_other"))) <= within
    return marked.join(spread, [*by, "_bucket"], "left").where(close).select(*left.columns).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in ``order``."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def nearest_month(wanted: DataFrame, measured: DataFrame, fields: list[str]) -> DataFrame:
    """For (symbol, month): each field from the nearest measured month with one above 0, ties to the earlier;

    then from the pooled row (month null), then the median over all pooled rows.  ``source`` says which level the
    first field came from.
    """
    months = measured.where("month IS NOT NULL").select("symbol", F.col("month").alias("_m"), *(F.col(f).alias(f"_{f}") for f in fields))
    pairs = wanted.join(months, "symbol", "left")
    usable = lambda c: (F.col(c) > 0) & ~F.isnan(c)
    away = F.struct(F.abs(F.col("_m") - F.col("month")), F.col("_m"))
    own = pairs.groupBy("symbol", "month").agg(*(F.min_by(F.when(usable(f"_{f}"), F.col(f"_{f}")), F.when(usable(f"_{f}"), away)).alias(f"_own_{f}") for f in fields))
    pooled = measured.where("month IS NULL").select("symbol", *(F.when(usable(f), F.col(f)).alias(f"_pool_{f}") for f in fields))
    overall = pooled.agg(*(F.median(f"_pool_{f}").alias(f"_all_{f}") for f in fields))
    found = own.join(pooled, "symbol", "left").join(F.broadcast(overall))
    out = [F.coalesce(f"_own_{f}", f"_pool_{f}", f"_all_{f}").alias(f) for f in fields]
    f = fields[0]
    level = F.when(F.col(f"_own_{f}").isNotNull(), "month").when(F.col(f"_pool_{f}").isNotNull(), "pooled")
    return found.select("symbol", "month", *out, level.when(F.col(f"_all_{f}").isNotNull(), "universe").alias("source"))
