"""Connected components of a graph of any size: alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Scratch, join_counted


def _least(edges: DataFrame, total: int, scratch: Scratch, name: str) -> DataFrame:
    """Adds, to each edge (u, v), the least of u and all its neighbours; ``total`` is the number of edges, about."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = scratch.put(least.select("u", F.least("u", "m").alias("m"), "n"), name)
    return join_counted(edges, least, ["u"], "n", total).drop("n")


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the least node of its component.

    Each round hangs a node's larger neighbours on the least one it knows, then the smaller ones; the graph has
    become stars when a round changes nothing.  Hubs, which have most edges, are joined by broadcasts.  Every round is a table in the shared folder, so lineage stays short.
    """
    both = edges.where("u <> v")
    now = scratch.put(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, total = None, now.count()
    for k in range(1, most_rounds):
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(turned, 2 * total, scratch, f"{name}-large-{k}").where("v > u")
        large = scratch.put(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-hung-{k}")
        hung = _least(large, total, scratch, f"{name}-small-{k}")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        now = scratch.put(small.where("u <> v").distinct(), f"{name}-{k}")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = sums[0]
        for done in (f"{name}-{k - 1}", f"{name}-large-{k}", f"{name}-hung-{k}", f"{name}-small-{k}"):
            scratch.drop(done)
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
