"""Scores of predictions against curated labels; NULL where a rate is undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.cells import safe_divide


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of a two-way decision; rows without a label are left out, no prediction is a negative one."""
    said = F.coalesce(predicted, F.lit(False))
    known = rows.withColumns({"_said": said, "_true": actual}).filter(F.col("_true").isNotNull())
    counts = known.groupBy(*(by or [])).agg(
        F.count_if(F.col("_said") & F.col("_true")).alias("tp"),
        F.count_if(F.col("_said") & ~F.col("_true")).alias("fp"),
        F.count_if(~F.col("_said") & ~F.col("_true")).alias("tn"),
        F.count_if(~F.col("_said") & F.col("_true")).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "sensitivity": safe_divide(tp, tp + fn), "specificity": safe_divide(tn, tn + fp),
        "f1": safe_divide(2 * tp, 2 * tp + fp + fn), "accuracy": safe_divide(tp + tn, tp + fp + tn + fn),
        "fpr": safe_divide(fp, fp + tn), "fnr": safe_divide(fn, fn + tp),
    })


def column_set_scores(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Precision, recall and F1 of multisets ``source_id, name``, over all sources."""
    a = predicted.groupBy("source_id", "name").agg(F.count("*").alias("said"))
    b = actual.groupBy("source_id", "name").agg(F.count("*").alias("true"))
    both = a.join(b, ["source_id", "name"], "full").na.fill(0, ["said", "true"])
    sums = both.agg(F.sum(F.least("said", "true")).alias("tp"), F.sum(F.greatest(F.col("said") - F.col("true"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("true") - F.col("said"), F.lit(0))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "f1": safe_divide(2 * tp, 2 * tp + fp + fn)})


def column_set_detail(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """The same for each source alone."""
    a = predicted.groupBy("source_id", "name").agg(F.count("*").alias("said"))
    b = actual.groupBy("source_id", "name").agg(F.count("*").alias("true"))
    both = a.join(b, ["source_id", "name"], "full").na.fill(0, ["said", "true"])
    over = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    sums = both.groupBy("source_id").agg(F.sum(F.least("said", "true")).alias("tp"), over("said", "true").alias("fp"), over("true", "said").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "f1": safe_divide(2 * tp, 2 * tp + fp + fn)})


def transfer_totals(rows: DataFrame, received: str, size: str, by: list[str] | None = None) -> DataFrame:
    """Bytes read and avoided: totals, reduction, mean and exact median."""
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.sum(received).alias("received"),
        F.sum(size).alias("whole"),
        F.round(100 * (1 - F.try_divide(F.sum(received).cast("double"), F.sum(size).cast("double"))), 4).alias("reduction_percent"),
        F.round(F.avg(received), 4).alias("mean_received"),
        F.median(received).alias("median_received"),
    )


def rate(test: Column) -> Column:
    """k of n, NULL when n is 0; unknown tests count in neither."""
    return F.round(F.try_divide(F.count_if(test).cast("double"), F.count(test).cast("double")), 4)


def header_scores(rows: DataFrame) -> DataFrame:
    """Accuracy of the header row and of the whole ordered header (case does not count)."""
    low = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    labelled = rows.filter("true_row IS NOT NULL OR true_header IS NOT NULL")
    return labelled.agg(
        rate(F.when(F.col("true_row").isNotNull(), F.coalesce(F.col("found_row") == F.col("true_row"), F.lit(False)))).alias("row_accuracy"),
        rate(F.when(F.col("true_header").isNotNull(), F.coalesce(low("found_header") == low("true_header"), F.lit(False)))).alias("exact_header"),
    )


def mapping_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy over all labelled columns and for each concept: ``source_id, name, said, true``."""
    right = F.coalesce(F.col("said") == F.col("true"), F.lit(False))
    known = rows.filter("true IS NOT NULL").withColumn("right", right)
    return known.groupingSets([[], ["true"]], "true").agg(F.grouping("true").alias("overall"), F.count("*").alias("n"), rate(F.col("right")).alias("accuracy"))


def agreement(rows: DataFrame, said: str, true: str) -> DataFrame:
    """Counts of each (label, guess); no guess is UNKNOWN."""
    return rows.filter(F.col(true).isNotNull()).groupBy(F.col(true).alias("actual"), F.coalesce(said, F.lit("UNKNOWN")).alias("guess")).agg(F.count("*").alias("n"))


def failure_counts(failures: DataFrame) -> DataFrame:
    """Failures by category, most frequent first, then by first occurrence."""
    return failures.groupBy("category").agg(F.count("*").alias("n"), F.min("position").alias("first")).orderBy(F.desc("n"), "first").drop("first")


def coverage(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row: how many sources there are, and the share for which each stage's test holds."""
    return rows.agg(F.count("*").alias("n"), *(rate(F.coalesce(test, F.lit(False))).alias(name) for name, test in stages.items()))


def stratified(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """The measures over all rows and for each value of each key; a NULL value is no stratum."""
    grouped = rows.groupingSets([[], *([k] for k in keys)], *keys).agg(*(F.grouping(k).alias(f"_all_{k}") for k in keys), *measures)
    stratum = F.coalesce(*(F.when(F.col(f"_all_{k}") == 0, F.lit(k)) for k in keys), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_all_{k}") == 0, F.col(k).cast("string")) for k in keys))
    named = grouped.withColumns({"stratum": stratum, "value": value}).filter("stratum = 'all' OR value IS NOT NULL")
    return named.drop(*keys, *(f"_all_{k}" for k in keys))


def probe_size_sweep(trials: DataFrame) -> DataFrame:
    """For each prefix size: found headers, agreement with the largest prefix that succeeded, mean bytes.

    ``trials``: ``source_id, probe_bytes, header (NULL: none), bytes_read``."""
    w = Window.partitionBy("source_id")
    largest = F.max_by(F.when(F.col("header").isNotNull(), F.col("header")), F.when(F.col("header").isNotNull(), F.col("probe_bytes"))).over(w)
    compared = trials.withColumn("reference", largest)
    same = F.when(F.col("reference").isNotNull(), F.coalesce(F.col("header") == F.col("reference"), F.lit(False)))
    return compared.groupBy("probe_bytes").agg(
        F.count_distinct("source_id").alias("sources"), rate(F.col("header").isNotNull()).alias("detection_rate"), rate(same).alias("agreement"), F.round(F.avg("bytes_read"), 4).alias("mean_bytes")
    )


def manifest_messages(manifest: DataFrame, predicted: str = "predicted_header", actual: str = "true_header") -> DataFrame:
    """What is wrong with a manifest, as rows; scoring goes on all the same.

    Labels that equal the predictions in every comparable row (three at least) were
    probably copied from them."""
    both = F.col(predicted).isNotNull() & F.col(actual).isNotNull() & (F.col(predicted) != "") & (F.col(actual) != "")
    totals = manifest.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("accession"), F.lit("")) == "").alias("unnamed"), F.count_if(both).alias("comparable"), F.count_if(both & (F.col(predicted) == F.col(actual))).alias("identical"), (F.count("accession") - F.count_distinct("accession")).alias("repeated"))
    message = F.array_compact(F.array(
        F.when(F.col("rows") == 0, "the manifest has no rows"),
        F.when(F.col("unnamed") > 0, "rows without an accession"),
        F.when(F.col("repeated") > 0, "accessions that occur more than once"),
        F.when((F.col("comparable") >= 3) & (F.col("comparable") == F.col("identical")), "labels equal the predictions in every row"),
    ))
    return totals.select(F.explode(message).alias("message"))


def fill_predictions(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """A manifest with predictions filled in by accession; its labels are never touched."""
    mine = [c for c in results.columns if c != "accession" and not c.startswith("true_")]
    old = [c for c in manifest.columns if c not in mine]
    return manifest.select(*old).join(results.select("accession", *mine), "accession", "left")
