"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled (by a hash of their ids) and served in that order, again from the first when
a target is above the source's size.  A document's virtual finish time is its source's words up to and with it,
divided by the source's target.  All documents' passes, range-sorted by that time, are the mix, and it is truncated
where the total budget, the sum of all targets in whole words, is served.  That is virtual time 1; a document that is
in service there is two packets, of which the first finishes just then.

Defined cases: a null text has no words; null is a source of its own, the last; a source without words has target 0;
rows that repeat a doc_id are served one after another; texts are counted whole; an empty table gives an empty result;
columns besides ``doc_id``, ``source`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, prefix_sums, text_key, text_or_empty

#: Runs of characters that are no ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds weight and target to one row a source (source, source_size).

    Targets are in proportion to weight, stop at ``cap`` times the source's size, and what is above goes to the
    other sources by weight.  In order of size over weight the capped sources come first, so the share of one unit
    of weight is found at the first source that it leaves below its cap.
    """
    code_points = F.hex(F.encode("source", "UTF-8"))
    nth = F.row_number().over(W.orderBy(code_points.asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))) + 1))
    weighed = weighed.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = W.orderBy("_ratio", code_points.asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    unit = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("_unit", unit)
    level = F.min(F.when(F.col("_ratio") > F.col("_unit"), F.struct("_ratio", "_unit"))).over(W.partitionBy())["_unit"]
    target = F.when(level.isNull() | (F.col("_ratio") <= level), F.col("_cap")).otherwise(F.col("weight") * level)
    return levels.withColumn("target", target.cast("double")).drop("_cap", "_ratio", "_unit")


def packets(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix",
    row: str | None = None,
) -> DataFrame:
    """The queue: row, doc_id, text_key, source, size, source_size, target, pass, first, length, finish, at, words.

    A packet is a pass of a document, or a part of one: ``length`` words from its word ``first`` on.  ``finish`` is its
    virtual finish time, ``at`` the words of all packets that finish before, over all sources, and ``words`` those that
    the budget leaves it.  Rows of one doc_id are served by their texts, and equal ones as they are stored.  Sources are
    sorted together, so none of them meets in one task.  ``row`` names a column of ``docs`` that numbers its rows; without
    one they are numbered here, once, and the numbers hold for the rows returned only.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"), text_key().alias("text_key"),
    )
    sized = scratch.put(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = W.orderBy(F.hex(F.encode("source", "UTF-8")).asc_nulls_last())
    earlier = F.coalesce(F.sum("source_size").over(by_source.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sources = scratch.put(
        targets(sources, share, cap, weights).withColumns({"nth": F.row_number().over(by_source), "_earlier": earlier}), "sources"
    )
    order = [
        F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")),
        F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.col("text_key"),
        F.col("row"),
    ]
    queued = prefix_sums(sized, order, "size", "_all", scratch)
    both = queued.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    served = both.select(
        "row", "doc_id", "text_key", "d.source", "nth", "size", "source_size", "target",
        (F.col("_all") - F.col("_earlier")).alias("_before"),
        F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))).alias("pass"),
    )
    served = served.withColumn("_before", F.col("_before") + F.col("pass") * F.col("source_size"))
    left = F.floor("target") - F.col("_before")  # words until virtual time 1
    part = lambda first, length: F.struct(first.alias("first"), length.cast("long").alias("length"))
    whole = F.array(part(F.lit(0).cast("long"), F.col("size")))
    split = F.array(part(F.lit(0).cast("long"), left), part(left.cast("long"), F.col("size") - left))
    parts = served.withColumn("_part", F.explode(F.when((left > 0) & (left < F.col("size")), split).otherwise(whole)))
    parts = parts.select("*", "_part.first", "_part.length").drop("_part")
    finish = F.when(F.col("target") > 0, (F.col("_before") + F.col("first") + F.col("length")) / F.col("target"))
    timed = parts.withColumn("finish", finish).drop("_before")
    by_time = [F.coalesce("finish", F.lit(0.0)), F.col("nth"), F.col("pass"), F.col("first"), F.col("length"), F.col("text_key"), F.col("row")]
    timed = prefix_sums(timed, by_time, "length", "at", scratch)
    budget = sources.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)).alias("_budget"))  # one row
    within = F.greatest(F.lit(0), F.least(F.col("length"), F.col("_budget") - F.col("at"))).cast("long")
    return timed.join(F.broadcast(budget)).withColumn("words", within).drop("_budget")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row a document: row, doc_id, text_key, source, size, source_size, target, taken, finish (of its first pass)."""
    same = ["row", "doc_id", "text_key", "source", "size", "source_size", "target"]
    found = packets(docs, **settings).groupBy(*same)
    return found.agg(F.sum("words").alias("taken"), F.max(F.when(F.col("pass") == 0, F.col("finish"))).alias("finish"))


def mixed_order(queue: DataFrame, total: int, words_per_range: int = 4_000_000) -> DataFrame:
    """The mix in its order: packets that the budget serves, dealt to ranges of equal words by ``at`` and sorted.

    All that are served have ``total`` words, so the ranges need no sampling; other columns of ``queue`` come along.
    """
    served = queue.where("words > 0")
    ranges = max(1, -(-total // words_per_range))
    here = F.floor(F.col("at") / F.lit(words_per_range)).cast("int")
    return served.repartitionById(ranges, here).sortWithinPartitions("at")
