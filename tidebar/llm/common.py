"""Helpers that the training-data operators share: inputs, shared scratch tables, slices of batches, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is chosen only where the session names none and runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/spark-{uuid.uuid4().hex[:6]}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def text_key(name: str = "text") -> Column:
    """128 bits of the text's SHA-256, to join by in place of the text."""
    return F.unhex(F.substring(F.sha2(text_or_empty(name), 256), 1, 32))


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.get(name, df)

    def put_bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """A table in ``n`` buckets by ``key``: joins and groups by it exchange no rows of this side again.

        The catalog knows it only while it is resolved; its files stay.
        """
        known = f"tidebar_{uuid.uuid4().hex}"
        writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("compression", "zstd")
        writer.option("path", self.path(name)).saveAsTable(known)
        found = self.spark.table(known)
        found.schema  # noqa: B018  resolves it
        self.spark.sql(f"DROP TABLE {known}")
        return found

    def get(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Removes a table that no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
        begin = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        yield batch.slice(begin)


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """``rows`` with their row of ``groups``, whose column ``count`` says how many rows of ``total`` have its key.

    Keys with more than one in ``most`` of all rows, of which there are at most ``most``, are joined by a broadcast, so
    no task gets all rows of a hot key; the others are joined as usual.
    """
    hot = groups.where(F.col(count) * most > total)
    hot_rows = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = others.join(groups.where(F.col(count) * most <= total), keys, how)
    return hot_rows.unionByName(rest)


def prefix_sums(
    df: DataFrame, order: list[Column], value: str, out: str, scratch: Scratch, rows_per_range: int = 100_000
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in ascending ``order`` (a unique key).

    Rows are range-sorted and written; each range adds its total, and a running sum within a range is shifted by
    the totals before it.  Only one row a range is ever gathered in one place.
    """
    names = [f"_order{k}" for k in range(len(order))]
    n, tag = max(1, -(-df.count() // rows_per_range)), uuid.uuid4().hex[:8]
    ranged = df.select("*", *(c.alias(k) for c, k in zip(order, names, strict=True))).repartitionByRange(n, *names)
    ranged = scratch.put(ranged.withColumn("_range", F.spark_partition_id()), f"ranged-{tag}")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(W.orderBy("_range")) - F.col("_total")).alias("_before"))
    within = W.partitionBy("_range").orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    running = ranged.withColumn("_running", F.coalesce(F.sum(value).over(within), F.lit(0)))
    shifted = running.join(before, "_range", "left")
    return shifted.withColumn(out, (F.col("_running") + F.col("_before")).cast("long")).drop(
        "_range", "_running", "_before", *names
    )
