"""A session as the operators expect it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "statsift", **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow, and the last value of a repeated map key."""
    builder = SparkSession.builder.appName(name)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
