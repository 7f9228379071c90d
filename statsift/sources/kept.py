"""Tables that must not be made twice, such as answers to requests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only where all runs in one process may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="statsift-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``rows`` dealt over all tasks by their key.

    For rows that take far longer than they are large: a small file is one split, and so one task, whatever its rows cost.
    With ``most``, rows are counted, and tasks are as many as give each about that many rows at most: what a task holds does not grow with the table."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(tasks, -(-rows.count() // most)) if most else tasks, key)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its requests are sent once, also if an executor is lost later."""
    path = f"{shared_folder(df.sparkSession)}/statsift/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
