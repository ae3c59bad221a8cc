"""Tables in the folder that driver and executors share, and ranks over whole tables without one task for all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one is chosen only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/spark-{uuid.uuid4().hex[:6]}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again; lineage is cut there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_counts(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, column, n, below): each value that is there, how many rows have it, and how many have a lesser one.

    With ``keys`` both are counted inside each key.  Values are counted before they are exchanged and sorted by ranges, so
    a hot key or value takes no task alone; only one row a range and key meets in one place.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange(*keys, column).withColumn("_range", F.spark_partition_id()), "ranked")
    totals = ranged.groupBy("_range", *keys).agg(F.sum("n").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_total")).drop("_total")
    within = F.coalesce(F.sum("n").over(W.partitionBy("_range", *keys).orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("_own", within)
    for k in keys:
        before = before.withColumnRenamed(k, f"_k_{k}")
    same = own["_range"] == before["_range"]
    for k in keys:
        same = same & own[k].eqNullSafe(before[f"_k_{k}"])
    both = own.join(before if keys else F.broadcast(before), same)
    return both.select(*keys, column, "n", (F.col("_own") + F.col("_before")).alias("below"))


def percentiles(df: DataFrame, column: str, fractions: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, cuts): the values at the fractions of the rows, exact, interpolated linearly between neighbours by rank.

    Works on the counts of values: a row of counts gives out the wanted ranks that fall in it, at most two a fraction, so no
    task holds a whole table's or key's values.  Without values there is no row.
    """
    counts = value_counts(df, column, keys)
    sizes = counts.groupBy(*keys).agg(F.max(F.col("below") + F.col("n")).alias("_size"))
    for k in keys:
        sizes = sizes.withColumnRenamed(k, f"_s_{k}")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    ranked = counts.join(sizes, same) if keys else counts.join(F.broadcast(sizes))
    at = lambda p: F.lit(p) * (F.col("_size") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in fractions))))
    own = F.filter(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    hits = ranked.select(*keys, "_size", F.col(column).cast("double").alias("_x"), F.explode(own).alias("_rank"))
    known = hits.groupBy(*keys).agg(F.max("_size").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    known = known.where("_size > 0")
    low, high = (lambda p: F.col("_at")[F.floor(at(p))]), (lambda p: F.col("_at")[F.ceil(at(p))])
    share = lambda p: at(p) - F.floor(at(p))
    cuts = F.array(*(low(p) + (high(p) - low(p)) * share(p) for p in fractions))
    return known.select(*keys, cuts.alias("cuts"))
