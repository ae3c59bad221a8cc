"""Which symbols: liquidity ranking, ladders, splits of the calendar, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOORS = (1e5, 2.5e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7, 1e8)


def nearest_rank(values: Column, q: float) -> Column:
    """Of an array: the sorted element at round((n - 1) * q), halves up."""
    at = F.floor((F.size(values) - 1) * F.lit(q) + 0.5).cast("int")
    return F.get(F.sort_array(values), at)


def upper_median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The sorted element n // 2 of each key, by row numbers, so no key's values are gathered."""
    own = W.partitionBy(*keys)
    ranked = df.withColumn("_k", F.row_number().over(own.orderBy(column)) - 1).withColumn("_n", F.count("*").over(own))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*keys, F.col(column).alias("median"))


def rank_liquidity(samples: DataFrame, reference: DataFrame, least: int) -> DataFrame:
    """(symbol, session, dollar_volume) by upper median, of symbols in ``reference`` with enough sessions."""
    own = samples.where("dollar_volume > 0")
    counts = own.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last")
    )
    found = counts.where(F.col("sessions") >= least).join(upper_median(own, ["symbol"], "dollar_volume"), "symbol")
    found = found.join(reference, "symbol")
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("median"), "symbol")))


def ladder(universe: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Symbols, and delisted ones, whose median is at least each floor."""
    steps = universe.select("median", "delisted", F.explode(F.array(*map(F.lit, floors))).alias("floor"))
    over = F.col("median") >= F.col("floor")
    return steps.groupBy("floor").agg(F.count_if(over).alias("symbols"), F.count_if(over & F.col("delisted")).alias("delisted"))


def eligible(bars: DataFrame, least: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("bars")).where(F.col("bars") >= least)


def deepest(bars: DataFrame, k: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("bars")).orderBy(F.desc("bars"), "symbol").limit(k)


def split_bounds(bars: DataFrame, res_ms: int, fractions: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """One row (b0, b1): the least aligned times before which at least so much of all bars lies."""
    slots = bars.groupBy(((F.floor(F.col("ts_ms") / res_ms) + 1) * res_ms).cast("long").alias("at")).agg(F.count("*").alias("n"))
    running = slots.withColumn("_before", F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    total = slots.agg(F.sum("n").alias("_total"))
    goal = lambda f: F.floor(F.col("_total") * F.lit(f) + 0.5)
    both = running.join(F.broadcast(total))
    return both.agg(*(F.min(F.when(F.col("_before") >= goal(f), F.col("at"))).alias(k) for f, k in zip(fractions, ("b0", "b1"), strict=True)))


def with_split(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    part = F.when(F.col("ts_ms") < F.col("b0"), "train").when(F.col("ts_ms") < F.col("b1"), "val").otherwise("test")
    return bars.join(F.broadcast(bounds)).withColumn("split", part).drop("b0", "b1")


def restricted(bars: DataFrame, least: int, res_ms: int, symbols: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The bars of ``symbols`` (symbol) that have at least ``least``, with their split.

    Bounds are those of all symbols with enough bars, before the restriction, unless given: a smaller universe is split at
    the same times.
    """
    enough = bars.join(eligible(bars, least).select("symbol"), "symbol", "left_semi")
    found = split_bounds(enough, res_ms) if bounds is None else bounds
    return with_split(enough.join(symbols.select("symbol").distinct(), "symbol", "left_semi"), found)


def by_liquidity(names: DataFrame, value: str = "adv") -> DataFrame:
    """``names`` (symbol, value) with rank from 1, least first: one that isn't a finite number comes before all, ties by symbol."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return names.withColumn("rank", F.row_number().over(W.orderBy(F.when(finite, F.col(value)).asc_nulls_first(), "symbol")).cast("long"))


def fingerprint(bars: DataFrame, res_ms: int, bounds: DataFrame) -> DataFrame:
    """SHA-256 over resolution, bounds and each symbol's length and extent; one line a symbol."""
    lines = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    line = F.concat_ws(":", "symbol", "n", "a", "b")
    body = lines.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_body"))
    whole = F.concat_ws("\n", F.lit(str(res_ms)), "b0", "b1", "_body")
    return body.join(F.broadcast(bounds)).select(F.sha2(whole, 256).alias("fingerprint"))


def strided(bars: DataFrame, first: int, context: int) -> DataFrame:
    """Anchors of windows that do not overlap: places first, first + context, ... with a whole window after them."""
    own = W.partitionBy("symbol")
    found = bars.withColumn("i", F.row_number().over(own.orderBy("ts_ms")) - 1).withColumn("_n", F.count("*").over(own))
    inside = (F.col("i") >= first) & ((F.col("i") - first) % context == 0) & (F.col("i") + context <= F.col("_n"))
    return found.where(inside).drop("_n")


def ticker_parts(symbols: DataFrame) -> DataFrame:
    """Symbols dealt by rank: of six, four to train, one to val, one to test."""
    k = F.pmod(F.row_number().over(W.orderBy("symbol")) - 1, F.lit(6))
    return symbols.withColumn("part", F.when(k < 4, "train").when(k == 4, "val").otherwise("test"))


def block_sample(bars: DataFrame, size: int, blocks: int, seed: int = 0) -> DataFrame:
    """Bars of ``blocks`` blocks of ``size`` bars of each symbol, chosen without replacement by a seeded hash."""
    i = F.row_number().over(W.partitionBy("symbol").orderBy("ts_ms")) - 1
    found = bars.withColumn("block", F.floor(i / size))
    keys = found.select("symbol", "block").distinct()
    nth = F.row_number().over(W.partitionBy("symbol").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "symbol", "block"), 256)))
    return found.join(keys.withColumn("_nth", nth).where(F.col("_nth") <= blocks).drop("_nth"), ["symbol", "block"], "left_semi")


def quotas(counts: DataFrame, total: int) -> DataFrame:
    """(symbol, capacity) with shares of ``total`` in proportion, by largest remainder, ties by symbol."""
    whole = W.partitionBy()
    n, share = F.sum("capacity").over(whole), F.col("capacity") * F.lit(total).cast("long")
    found = counts.withColumn("_rest", share % n).withColumn("_floor", ((share - F.col("_rest")) / n).cast("long"))
    left = F.lit(total) - F.sum("_floor").over(whole)
    nth = F.row_number().over(W.orderBy(F.desc("_rest"), "symbol"))
    return found.withColumn("quota", (F.col("_floor") + F.when(nth <= left, 1).otherwise(0)).cast("long")).drop("_floor", "_rest")


def word(*parts: Column | str) -> Column:
    """The first 32 bits of an MD5 over the parts, as a long: a seeded draw that any engine gives."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def pinned(counts: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """(turn, draw, symbol, place): ``total`` windows over symbols of (symbol, capacity), fixed by the seed.

    Symbols get quotas by largest remainder, never above their capacity.  A symbol's picks stand in the middles of as many
    equal parts of its windows, all moved round by one phase.  In turns each symbol with picks left gives one, in the order
    of a seeded draw, so any first part is spread over symbols, too: order by (turn, draw, symbol).
    """
    some = counts.where("capacity > 0").withColumn("capacity", F.col("capacity").cast("long"))
    n = some.agg(F.coalesce(F.sum("capacity"), F.lit(0))).first()[0]
    if not n or total <= 0:
        return some.select(F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("draw"), "symbol", F.lit(0).cast("long").alias("place")).limit(0)
    dealt = quotas(some, min(total, n)).where("quota > 0")
    turns = dealt.select("symbol", "capacity", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("turn"))
    middle = F.floor((2 * F.col("turn") + 1) * F.col("capacity") / (2 * F.col("quota"))).cast("long")
    phase = word(F.lit("phase"), F.lit(seed), "symbol") % F.col("capacity")
    return turns.select("turn", word(F.lit("order"), F.lit(seed), "symbol").alias("draw"), "symbol", ((middle + phase) % F.col("capacity")).alias("place"))


def sampled_sessions(days: DataFrame, n: int) -> DataFrame:
    """``n`` days evenly spaced over the span of ``days`` (day), weekends rolled back to Friday, each once."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    each = span.select("a", F.datediff("b", "a").alias("_span"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    found = each.select(F.expr(f"date_add(a, CAST(k * _span DIV {max(n - 1, 1)} AS INT))").alias("day"))
    return found.select(F.date_sub("day", F.greatest(F.weekday("day") - 4, F.lit(0))).alias("day")).distinct()


def identity_cut(bars: DataFrame, breaks: DataFrame, identities: DataFrame, worst: int = 16, within_ms: int = 20 * 86_400_000) -> DataFrame:
    """Bars from the newest break on at which a symbol became another company.

    Of a symbol's ``worst`` breaks by severity, one is confirmed where the last identity known before it and the first
    known after it, each at most ``within_ms`` away, are there and differ.
    """
    nth = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("severity"), F.desc("ts_ms")))
    top = breaks.select("symbol", "ts_ms", "severity").withColumn("_k", nth).where(F.col("_k") <= worst).drop("_k")
    near = top.alias("b").join(identities.alias("i"), "symbol").where(F.abs(F.col("i.at_ms") - F.col("b.ts_ms")) <= within_ms)
    before = F.max_by(F.when(F.col("at_ms") < F.col("ts_ms"), F.col("identity")), F.when(F.col("at_ms") < F.col("ts_ms"), F.col("at_ms")))
    after = F.min_by(F.when(F.col("at_ms") >= F.col("ts_ms"), F.col("identity")), F.when(F.col("at_ms") >= F.col("ts_ms"), F.col("at_ms")))
    sides = near.groupBy("symbol", "ts_ms").agg(before.alias("_before"), after.alias("_after")).where("_before <> _after")
    cut = sides.groupBy("symbol").agg(F.max("ts_ms").alias("_cut"))
    return bars.join(cut, "symbol", "left").where("_cut IS NULL OR ts_ms >= _cut").drop("_cut")
