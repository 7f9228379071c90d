"""Search over a table of studies: union of hits, filters with counts, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.cells import contains_any
from statsift.operators.ancestry import match_score
from statsift.operators.samples import implied_total

# Traits left out unless asked for; categories of failure that mean absence rather than ignorance.
DEFAULT_EXCLUDES = ["Gene-based burden"]
DEFINITE_ABSENCE = ("file_not_found", "http_404", "not_represented")


def search_traits(traits: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first entry of each label that matches, in order of position."""
    hits = traits.filter((F.col("resource") == "trait") & contains_any(F.col("label"), [text]))
    first = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("position"))
    return hits.withColumn("nth", first).filter("nth = 1").drop("nth").orderBy("position").limit(limit)


def merge_hits(*hits: DataFrame) -> DataFrame:
    """Hits of several searches, one row a study: the first search's row wins, all its traits are kept."""
    union = None
    for i, h in enumerate(hits):
        h = h.withColumn("search", F.lit(i))
        union = h if union is None else union.unionByName(h, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("accession").orderBy("search", "position"))
    traits = F.array_sort(F.collect_set("trait").over(Window.partitionBy("accession")))
    return union.withColumns({"nth": first, "traits": traits}).filter("nth = 1").drop("nth")


def exclude(studies: DataFrame, parts: list[str] | None = None, column: str = "trait") -> tuple[DataFrame, DataFrame]:
    """Studies whose trait holds none of the parts, and one row with how many went; an unknown trait stays."""
    marked = studies.withColumn("excluded", contains_any(F.col(column), parts if parts is not None else DEFAULT_EXCLUDES))
    return marked.filter("NOT excluded").drop("excluded"), marked.agg(F.count_if("excluded").alias("excluded"), F.count("*").alias("of"))


def search(studies: DataFrame, population: str | None = None, limit: int = 25, excludes: list[str] | None = None, sumstats_only: bool = False) -> DataFrame:
    """The best studies: population score, summary statistics, sample size, all falling; then as they came."""
    kept, _ = exclude(studies, excludes)
    if sumstats_only:
        kept = kept.filter("has_sumstats")
    scored = kept.withColumn("match", match_score(F.lit(population).cast("string"), F.col("ancestries"))).filter("match.score > 0")
    n = implied_total(F.col("n_total"), F.col("n_cases"), F.col("n_controls"))
    ranked = scored.withColumn("implied_n", n).orderBy(F.desc("match.score"), F.desc(F.coalesce("has_sumstats", F.lit(False))), F.desc(F.coalesce("implied_n", F.lit(0))), "position")
    return ranked.limit(limit)


def candidate_order() -> list[Column]:
    """READY before PARTIAL before NOT_READY, sufficient metadata, sample size, year, then as they came."""
    order = F.when(F.col("verdict") == "READY", 3).when(F.col("verdict") == "PARTIAL", 2).when(F.col("verdict") == "NOT_READY", 1).otherwise(0)
    return [F.desc(order), F.desc(F.coalesce("api_sufficient", F.lit(False))), F.desc(F.coalesce("n", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), F.asc("position")]


def rank_candidates(assessed: DataFrame, limit: int = 10) -> DataFrame:
    """Assessed studies by verdict, sufficient metadata, sample size and year."""
    return assessed.orderBy(*candidate_order()).limit(limit)


def availability(found: Column, category: Column) -> Column:
    """TRUE where a file was found, FALSE where its absence is certain, else NULL."""
    return F.when(found, True).when(category.isin(*DEFINITE_ABSENCE), False)


def enrich(studies: DataFrame, publications: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Studies with what is known of their publication and sidecar; what is not known stays NULL."""
    return studies.join(publications, "accession", "left").join(sidecars, "accession", "left")


def coalesce_routes(wanted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Each accession's study from the first route that has it."""
    a = first.select("accession", F.struct(*first.columns).alias("a"))
    b = second.select("accession", F.struct(*(c for c in first.columns)).alias("b"))
    return wanted.join(a, "accession", "left").join(b, "accession", "left").select(F.coalesce("a", "b").alias("study"), F.when(F.col("a").isNotNull(), "v2").when(F.col("b").isNotNull(), "v1").alias("route"), "accession")


def transfer_of_run(files: DataFrame) -> DataFrame:
    """Bytes read in a run of many files, and the share that was avoided."""
    size, read = F.sum(F.coalesce("size", F.lit(0))), F.sum(F.coalesce("bytes_read", F.lit(0)))
    return files.agg(read.alias("bytes_read"), size.alias("bytes_whole"), F.when(size > 0, F.round(100 * (1 - read / size), 4)).alias("avoided_percent"))
