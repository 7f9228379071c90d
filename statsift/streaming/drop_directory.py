"""Files that arrive in a directory, and the rate at which they fail."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift.operators.payload import classify
from statsift.sources.prefix import UrlTransport, target_reader


def arriving_files(spark: SparkSession, directory: str, files_a_trigger: int = 1000, probe_bytes: int = 262_144) -> DataFrame:
    """New files' first bytes with their classification.

    The stream lists paths alone; tasks read no more than ``probe_bytes`` of each file, in any
    store that pyarrow knows.  A file that cannot be read is a row with a failure ``category``
    and the kind ``UNREADABLE``."""

    @F.pandas_udf("content binary, category string")
    def first_bytes(paths: pd.Series) -> pd.DataFrame:
        read = target_reader(f"{UrlTransport.__module__}:{UrlTransport.__name__}", 8.0, 3, probe_bytes)
        return pd.DataFrame([read(unquote(p.replace("file:", "", 1)) if p.startswith("file:") else p) for p in paths], columns=["content", "category"])

    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_trigger).load(directory)
    rows = raw.select(F.col("path").alias("source_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("arrived"), F.col("length").alias("size"), first_bytes("path").alias("start"), F.lit(None).cast("string").alias("content_type"))
    classified = classify(rows.select("source_id", "name", "arrived", "size", F.col("start.content").alias("content"), "content_type", F.col("start.category").alias("category")))
    return classified.withColumn("kind", F.when(F.col("category").isNotNull(), "UNREADABLE").otherwise(F.col("kind")))


def failure_rate(events: DataFrame, time: str = "arrived", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Share of classified files that are no data, in windows of event time."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"))
    return grouped.agg(F.count("*").alias("files"), F.count_if(F.col("kind") != "DATA").alias("failed")).withColumn("rate", F.col("failed") / F.col("files"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now as Parquet and stop."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
