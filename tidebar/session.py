"""A session with the settings that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidebar", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting; everything else is left to the cluster."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()
