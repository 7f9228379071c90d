"""Expressions over the cells of a benchmark manifest, which are all strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift.functions.cells import as_flag, trimmed

VERDICTS = ("READY", "PARTIAL", "NOT_READY", "UNKNOWN")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with every cell a string and nothing missing."""
    return spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"').csv(path).na.fill("")


def present(cell: Column) -> Column:
    """The cell, or NULL where it says nothing."""
    return F.when(~F.lower(trimmed(cell)).isin("", "nan", "none"), cell)


def header_cell(cell: Column) -> Column:
    """An ordered header: parted by tabs, else by commas, bars or spaces."""
    text = present(cell)
    parts = F.split(text, "\t")
    for d in (" ", "|", ","):  # the last test counts first
        parts = F.when(text.contains(d), F.split(text, "\\Q" + d + "\\E")).otherwise(parts)
    parts = F.when(text.contains("\t"), F.split(text, "\t")).otherwise(parts)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def mapping_cell(cell: Column) -> Column:
    """``raw=concept|raw=concept`` as a map; of repeated names the last counts, an empty concept is unknown."""
    items = F.filter(F.split(present(cell), r"\|"), lambda x: x.rlike(r"^\s*[^=\s][^=]*="))
    pairs = F.transform(items, lambda x: F.struct(trimmed(F.regexp_extract(x, "^([^=]*)=", 1)).alias("k"), trimmed(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    named = F.transform(last, lambda p: F.struct(p["k"], F.when(p["v"] == "", "unknown").otherwise(p["v"])))
    return F.when(F.size(items) > 0, F.map_from_entries(named))


def verdict_cell(cell: Column) -> Column:
    """A verdict, or what stands for one; NULL for any other word."""
    word = F.regexp_replace(F.upper(trimmed(present(cell))), "[ -]", "_")
    return F.when(word.isin("TRUE", "YES", "1"), "READY").when(word.isin("FALSE", "NO", "0"), "NOT_READY").when(word.isin(*VERDICTS), word)


def number_cell(cell: Column) -> Column:
    """A number that may carry commas."""
    return F.regexp_replace(present(cell), ",", "").try_cast("double")


def integer_cell(cell: Column) -> Column:
    return number_cell(cell).cast("bigint")


def boolean_cell(cell: Column) -> Column:
    return as_flag(present(cell))
