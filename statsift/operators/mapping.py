"""From raw column names to canonical concepts, as joins with the vocabulary.

A header is rows ``source_id, ordinal, raw``; order and duplicates count, so
``ordinal`` goes along everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.cells import normalised_name
from statsift.vocabulary import STRIPPED_CONFIDENCE, STRIPPED_PREFIX, Vocabulary


def explode_header(files: DataFrame, header: str = "header") -> DataFrame:
    """One row a column name from an array of names."""
    return files.select("source_id", F.posexplode(header).alias("ordinal", "raw"))


def _rules(name: Column, vocabulary: Vocabulary) -> Column:
    """The first rule that fits a name, as a struct (concept, confidence), else NULL."""
    made = lambda concept, confidence: F.struct(F.lit(concept).alias("concept"), F.lit(confidence).alias("confidence"))
    out = None
    for suffix, concept, confidence in vocabulary.suffix_rules:
        test = F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix))
        out = F.when(test, made(concept, confidence)) if out is None else out.when(test, made(concept, confidence))
    for part, concept, confidence in vocabulary.contains_rules:
        out = out.when(F.contains(name, F.lit(part)), made(concept, confidence))
    return out


def map_columns(header: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``source_id, ordinal, raw, normalised, concept, symbol, method, confidence``.

    Layers in order: the concept's own name, a known name, a known name behind
    ``hm_``, a rule; what fits none is ``unknown`` with confidence 0."""
    vocabulary = vocabulary or Vocabulary()
    spark = header.sparkSession
    known = vocabulary.table(spark).withColumnRenamed("name", "known_name")
    symbols = known.select(F.col("concept").alias("rule_concept"), F.col("symbol").alias("rule_symbol")).distinct()
    named = header.withColumn("normalised", normalised_name(F.col("raw")))
    direct = named.join(F.broadcast(known), F.col("normalised") == F.col("known_name"), "left")
    bare = known.select(F.col("known_name").alias("bare_name"), F.col("concept").alias("bare_concept"))
    stripped = F.when(F.startswith("normalised", F.lit(STRIPPED_PREFIX)), F.substr("normalised", F.lit(len(STRIPPED_PREFIX) + 1)))
    both = direct.join(F.broadcast(bare), stripped == F.col("bare_name"), "left")
    ruled = both.withColumn("rule", _rules(F.col("normalised"), vocabulary))
    by_rule = F.when(F.col("bare_concept").isNotNull(), F.struct(F.col("bare_concept").alias("concept"), F.lit(STRIPPED_CONFIDENCE).alias("confidence"))).otherwise(F.col("rule"))
    full = ruled.withColumn("by_rule", by_rule).withColumn("rule_key", F.col("by_rule.concept"))
    full = full.join(F.broadcast(symbols), F.col("rule_key") == F.col("rule_concept"), "left")
    return full.select(
        "source_id", "ordinal", "raw", "normalised",
        F.coalesce("concept", "by_rule.concept", F.lit("unknown")).alias("concept"),
        F.coalesce("symbol", "rule_symbol").alias("symbol"),
        F.coalesce("method", F.when(F.col("by_rule").isNotNull(), "heuristic"), F.lit("unknown")).alias("method"),
        F.coalesce("confidence", "by_rule.confidence", F.lit(0.0)).alias("confidence"),
    )


def duplicate_names(mapped: DataFrame) -> DataFrame:
    """Names that occur again in their header, each reported once, at its second place."""
    nth = F.row_number().over(Window.partitionBy("source_id", "normalised").orderBy("ordinal"))
    return mapped.withColumn("nth", nth).filter("nth = 2").drop("nth")


def first_for_concept(mapped: DataFrame) -> DataFrame:
    """The best column of each concept: highest confidence, then the earliest."""
    best = F.max_by(F.struct("ordinal", "raw", "confidence", "method"), F.struct(F.col("confidence"), -F.col("ordinal"))).alias("best")
    return mapped.filter("concept <> 'unknown'").groupBy("source_id", "concept").agg(best, F.count("*").alias("columns")).select("source_id", "concept", "best.*", "columns")


def split_resolved(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns that have a concept, and those that have none."""
    return mapped.filter("concept <> 'unknown'"), mapped.filter("concept = 'unknown'")


def renames(mapped: DataFrame, symbols: bool = False) -> DataFrame:
    """``source_id, raw, new_name``: only concepts that exactly one column claims."""
    target = F.col("symbol") if symbols else F.col("concept")
    claimed = F.count("*").over(Window.partitionBy("source_id", "concept"))
    return mapped.filter("concept <> 'unknown'").withColumn("claimed", claimed).filter("claimed = 1").select("source_id", "ordinal", "raw", target.alias("new_name"))


def keyword_arguments(mapped: DataFrame, least: float = 0.9) -> DataFrame:
    """For hand-off to other tools: concepts with one column and a confidence of ``least`` or more."""
    return first_for_concept(mapped).filter((F.col("columns") == 1) & (F.col("confidence") >= least)).select("source_id", "concept", "raw")


def rename_code(mapped: DataFrame) -> DataFrame:
    """A line of DataFrame code for each source that renames its columns."""
    entry = F.concat(F.lit('"'), F.col("raw"), F.lit('": "'), F.col("new_name"), F.lit('"'))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ordinal"), entry.alias("entry")))), lambda p: p["entry"]), ", ")
    return renames(mapped).groupBy("source_id").agg(F.concat(F.lit("df = df.withColumnsRenamed({"), listed, F.lit("})")).alias("code"))
