"""Reports as tidy rows (report, series, idx, value), and their lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_lines(tidy: DataFrame, decimals: int = 3) -> DataFrame:
    """``idx <tab> label=value,...`` of all series that have a value there."""
    pair = F.concat(F.col("series"), F.lit("="), F.format_string(f"%.{decimals}f", "value"))
    body = tidy.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", pair.alias("p")))), lambda x: x["p"]), ",").alias("body"))
    return body.select("idx", F.concat(F.col("idx").cast("string"), F.lit("\t"), "body").alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(idx, label, value) of the pairs with a number."""
    parts = lines.select("idx", F.explode(F.split(F.element_at(F.split("line", "\t"), 2), ",")).alias("p"))
    found = parts.select("idx", F.split_part("p", F.lit("="), F.lit(1)).alias("label"), F.split_part("p", F.lit("="), F.lit(2)).try_cast("double").alias("value"))
    return found.where("value IS NOT NULL")


def with_key(lines: DataFrame, key: str) -> DataFrame:
    return lines.where(F.col("line").rlike(rf"(^|[\t,]){key}="))


def extremes(tidy: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the greatest and the least values over their series."""
    rows = tidy.groupBy("idx").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    top = rows.orderBy(F.desc("high"), "idx").limit(k).select(F.lit("max").alias("side"), "idx", F.col("high").alias("value"))
    bottom = rows.orderBy("low", "idx").limit(k).select(F.lit("min").alias("side"), "idx", F.col("low").alias("value"))
    return top.unionByName(bottom)


def file_name(name: Column) -> Column:
    """Lower case, runs of anything else as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")


#: The format that ``read_scores`` takes, and no other.
SCORES_VERSION = 3


def write_scores(scores: DataFrame, path: str, version: int = SCORES_VERSION) -> None:
    """Scores of windows as lines of JSON, each with the format's version; numbers that are not finite keep their names."""
    if "format_version" in scores.columns:
        raise ValueError("format_version is the document's own")
    scores.withColumn("format_version", F.lit(version)).write.json(path)


def read_scores(spark: SparkSession, path: str, schema: str, version: int = SCORES_VERSION) -> DataFrame:
    """What ``write_scores`` wrote, without its version; another version, a line that can't be read, or no line is an error."""
    found = spark.read.schema(f"{schema}, format_version int").option("mode", "FAILFAST").json(path)
    rows, low, high, known = found.agg(F.count("*"), F.min("format_version"), F.max("format_version"), F.count("format_version")).first()
    if not rows:
        raise ValueError(f"{path} holds no windows")
    if known < rows or (low, high) != (version, version):
        raise ValueError(f"{path} has format version {low if low == high else (low, high)}, not {version}")
    return found.drop("format_version")


def newest_with_data(runs: DataFrame) -> DataFrame:
    """Of runs (name, touched, latest, generations) the one marked latest if it has any, else the newest by (touched, name) that has."""
    return runs.where("generations > 0").orderBy(F.col("latest").desc_nulls_last(), F.desc_nulls_last("touched"), F.desc("name")).limit(1)


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of lines (nth, line), in their order."""
    return lines.orderBy(F.desc("nth")).limit(n).orderBy("nth")
