"""The New York exchange's calendar as a table, and when an observation can have been known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Single weekdays on which the exchange stayed shut all day.
CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30",
    "2018-12-05", "2025-01-09",
)


def _nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th given weekday of a month."""
    before_first = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before_first, weekday), 7 * (n - 1))


def _last_monday(year: Column, month: int) -> Column:
    return F.date_sub(F.next_day(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), "Mon"), 7)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday, by the anonymous computus."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    at = h + m - 7 * n + 114
    return F.make_date(year, F.floor(at / 31).cast("int"), (at % 31 + 1).cast("int"))


def _observed(day: Column) -> Column:
    """Saturday holidays are kept on Friday, Sunday ones on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def holidays(year: Column) -> list[Column]:
    fixed = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    new_year = F.when(F.weekday(fixed(1, 1)) == 6, F.date_add(fixed(1, 1), 1)).when(F.weekday(fixed(1, 1)) != 5, fixed(1, 1))
    return [
        new_year, F.when(year >= 1998, _nth_weekday(year, 1, "Mon", 3)), _nth_weekday(year, 2, "Mon", 3), F.date_sub(easter(year), 2), _last_monday(year, 5),
        F.when(year >= 2022, _observed(fixed(6, 19))), _observed(fixed(7, 4)), _nth_weekday(year, 9, "Mon", 1),
        _nth_weekday(year, 11, "Thu", 4), _observed(fixed(12, 25)),
    ]


def sessions(spark: SparkSession, first: str, last: str, closures: tuple[str, ...] = CLOSURES) -> DataFrame:
    """(day): the trading days of a span; ``closures`` are single days on which the exchange stayed shut."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    shut = F.array_compact(F.array(*holidays(F.year("day"))))
    kept = days.where((F.weekday("day") < 5) & ~F.array_contains(shut, F.col("day")))
    return kept.where(~F.col("day").isin(*(F.to_date(F.lit(c)) for c in closures))) if closures else kept


def sessions_sql(first: str, last: str, closures: tuple[str, ...] = CLOSURES) -> str:
    """The same days as common table expressions that end in ``sessions``."""
    nth = lambda m, iso, n: f"make_date(y, {m}, 1) + (({iso} - isodow(make_date(y, {m}, 1)) + 7) % 7)::INTEGER + {7 * (n - 1)}"
    kept = lambda m, d: f"make_date(y, {m}, {d}) + CASE isodow(make_date(y, {m}, {d})) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END"
    shut = [
        "CASE isodow(make_date(y, 1, 1)) WHEN 7 THEN make_date(y, 1, 2) WHEN 6 THEN NULL ELSE make_date(y, 1, 1) END",
        f"CASE WHEN y >= 1998 THEN {nth(1, 1, 3)} END", nth(2, 1, 3), "easter - 2",
        "make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INTEGER", f"CASE WHEN y >= 2022 THEN {kept(6, 19)} END", kept(7, 4),
        nth(9, 1, 1), nth(11, 4, 4), kept(12, 25),
    ]
    return f"""days AS (
        SELECT d::DATE AS day FROM generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) t(d)
    ), golden AS (
        SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT DISTINCT year(day)::INTEGER AS y FROM days)
    ), epact AS (
        SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM golden
    ), letter AS (
        SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM epact
    ), moon AS (
        SELECT *, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS code FROM letter
    ), years AS (
        SELECT y::BIGINT AS y, make_date(y::BIGINT, (code // 31)::BIGINT, (code % 31 + 1)::BIGINT) AS easter FROM moon
    ), shut AS (
        SELECT unnest([{", ".join(shut)}]) AS day FROM years
        UNION ALL SELECT unnest([{", ".join(f"DATE '{c}'" for c in closures)}])
    ), sessions AS (
        SELECT day FROM days WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM shut WHERE day IS NOT NULL)
    )"""


def available_at(observations: DataFrame, sessions: DataFrame, released: str = "released") -> DataFrame:
    """Adds available_day: the first session after the day of release; trading starts there at 09:30 New York time."""
    both = observations.select(F.date_add(released, 1).alias("_from")).distinct()
    # sessions within ten days are candidates, so the range join has bounded fan-out
    cand = both.select("_from", F.explode(F.sequence("_from", F.date_add("_from", 10))).alias("day"))
    first = cand.join(sessions, "day").groupBy("_from").agg(F.min("day").alias("available_day"))
    return observations.withColumn("_from", F.date_add(released, 1)).join(first, "_from", "left").drop("_from")


def first_friday(day: Column) -> Column:
    """The first Friday of the month, on or after the day; else that of the next month."""
    own = F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri")
    later = F.next_day(F.date_sub(F.add_months(F.trunc(day, "month"), 1), 1), "Fri")
    return F.when(own >= day, own).otherwise(later)


def next_day_of_month(day: Column, n: int) -> Column:
    own = F.date_add(F.trunc(day, "month"), n - 1)
    return F.when(own >= day, own).otherwise(F.date_add(F.add_months(F.trunc(day, "month"), 1), n - 1))


#: Months and day of the rate decisions and of the product reports.
RATE_MONTHS, RATE_DAY = (1, 3, 5, 6, 7, 9, 11, 12), 15
PRODUCT_MONTHS, PRODUCT_DAY = (1, 4, 7, 10), 28


def next_yearly(day: Column, months: tuple[int, ...], of_month: int) -> Column:
    """The first of the yearly dates strictly after the day."""
    dates = [F.make_date(F.year(day) + F.lit(k), F.lit(m), F.lit(of_month)) for k in (0, 1) for m in months]
    return F.array_min(F.filter(F.array(*dates), lambda d: d > day))


def session_open_ms(day: Column) -> Column:
    """UTC milliseconds of the day's midnight in New York, across changes of the clock."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp_ntz").cast("string"), "America/New_York"))
