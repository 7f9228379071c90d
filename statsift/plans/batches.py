"""A benchmark's predictions in bounded batches that an interrupted run goes on from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift.operators import evaluate
from statsift.plans import accessions
from statsift.settings import Settings
from statsift.sources.catalogue import Routes

#: Accessions of a batch, about.
BATCH = 500
FINISHED = "batch int, of int"
PREDICTIONS = "accession string, predicted_verdict string, predicted_header string, predicted_route string, predicted_category string, bytes_received long, file_size long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def predict(manifest: DataFrame, settings: Settings | Routes, folder: str, batch: int = BATCH, stop_after: int | None = None) -> DataFrame:
    """Assess the manifest's accessions batch by batch: one row an accession, read from ``folder``.

    An accession's batch follows from its name, so a run that was stopped goes on with the batches
    that are not finished; a batch counts as finished once its rows are written whole.  How many batches
    there are is settled by the first run.  ``stop_after``: leave off after so many batches."""
    spark = manifest.sparkSession
    named = manifest.select(F.upper(F.trim("accession")).alias("accession")).filter("accession <> ''").distinct()
    finished = {r["batch"]: r["of"] for r in _stored(spark, f"{folder}/finished", FINISHED).collect()}  # a row a batch
    of = next(iter(finished.values()), None) or max(1, -(-named.count() // batch))
    done = 0
    for i in range(of):
        if i in finished:
            continue
        if stop_after is not None and done >= stop_after:
            break
        mine = named.filter(F.pmod(F.xxhash64("accession"), F.lit(of)) == i)
        got = accessions.assess(mine, settings).select(
            "accession", F.col("verdict").alias("predicted_verdict"), F.array_join("header", "\t").alias("predicted_header"), F.col("route").alias("predicted_route"),
            F.col("category").alias("predicted_category"), "bytes_received", F.col("size").alias("file_size"),
        )
        got.write.mode("overwrite").parquet(f"{folder}/predictions/part={i}")
        spark.createDataFrame([(i, of)], FINISHED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/finished/part={i}")
        done += 1
    whole = _stored(spark, f"{folder}/finished", FINISHED + ", part int").select("part")
    return _stored(spark, f"{folder}/predictions", PREDICTIONS + ", part int").join(F.broadcast(whole), "part", "left_semi").drop("part")  # a row a batch


def predicted(manifest: DataFrame, settings: Settings | Routes, folder: str, batch: int = BATCH) -> DataFrame:
    """The manifest with predictions filled in by accession; its labels are never touched."""
    keyed = manifest.withColumns({"_as_written": F.col("accession"), "accession": F.upper(F.trim("accession"))})
    filled = evaluate.fill_predictions(keyed, predict(manifest, settings, folder, batch))
    return filled.drop("accession").withColumnRenamed("_as_written", "accession").select("accession", *(c for c in filled.columns if c not in ("accession", "_as_written")))
