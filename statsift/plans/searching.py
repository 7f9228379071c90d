"""Search: trait index, the studies of each label until there are enough, free text for what is lacking, then the best.

Any number of searches run together: in each round every open search asks for one page,
so the rounds are as many as the longest search has pages, whatever the number of searches.
A search that has enough studies asks no further; order is kept by label, page and place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.cells import contains_any
from statsift.operators import catalog, discovery, samples
from statsift.operators.ancestry import match_score
from statsift.plans import accessions as routes_to_files
from statsift.settings import Settings
from statsift.sources import catalogue
from statsift.sources.catalogue import MOST_STUDIES, OVERSAMPLE, PAGE, Routes, routes_of
from statsift.sources.kept import keep

# Fixed value: labels of the trait index that a search goes through at most.
LABELS = 8
#: Places of a label's studies below each other; those of the free text come behind all labels.
STRIDE, BEHIND = 1_000_000, 1_000_000_000
STATE = "source_id string, label_rank int, label string, route string, page int, got long, sick boolean"


def labels_of(texts: DataFrame, settings: Settings | Routes, most: int = LABELS) -> DataFrame:
    """The first ``most`` labels of the trait index for ``source_id, text``: ``source_id, label_rank, label``, each label once."""
    hits = catalogue.text_hits(texts, settings, max(most * 4, 40)).filter("resource = 'trait' AND label IS NOT NULL")
    first = hits.groupBy("source_id", "label").agg(F.min("position").alias("position"))
    ranked = first.withColumn("label_rank", F.row_number().over(Window.partitionBy("source_id").orderBy("position")) - 1)
    return ranked.filter(F.col("label_rank") < most).select("source_id", "label_rank", "label")


def _wanted(each: int, sumstats_only: bool):
    """How many studies of a label are asked for, by route."""
    return F.when((F.col("route") == "v1") & F.lit(sumstats_only), min(each * OVERSAMPLE, MOST_STUDIES)).otherwise(each)


def _kept_hits(hits: DataFrame, done: DataFrame, each: int, sumstats_only: bool) -> DataFrame:
    """The studies of finished labels that count: those of the route that answered, in order, ``each`` a label at most."""
    mine = hits.join(done, ["source_id", "label_rank", "route"])
    order = Window.partitionBy("source_id", "label_rank").orderBy("page", "nth")
    asked = mine.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= _wanted(each, sumstats_only))
    if sumstats_only:
        asked = asked.filter("has_sumstats").withColumn("place", F.row_number().over(order))
    return asked.filter(F.col("place") <= each).withColumn("position", F.col("label_rank").cast("long") * STRIDE + F.col("place")).drop("page", "nth", "place")


def studies_of_labels(labels: DataFrame, settings: Settings | Routes, each: int, enough: int, sumstats_only: bool = False) -> DataFrame:
    """Studies of ``source_id, label_rank, label``, label after label until a source has ``enough`` of them.

    ``source_id, label_rank, label, position, route`` and the study.  The older route is asked for labels
    that the newer fails on, and for all later ones after an answer with an error; a label that both
    fail on gives nothing."""
    routes = routes_of(settings)
    spark, s = labels.sparkSession, routes.settings
    labels = keep(labels.select(F.col("source_id").cast("string").alias("source_id"), F.col("label_rank").cast("int").alias("label_rank"), "label"), "labels")
    first_route = F.when(F.col("sick") | F.lit(s.prefer_api_version == "v1"), "v1").otherwise("v2")
    start = labels.filter("label_rank = 0").withColumn("sick", F.lit(False))
    columns = [x.split()[0] for x in STATE.split(", ")]
    state = keep(start.withColumns({"route": first_route, "page": F.lit(0), "got": F.lit(0).cast("long")}).select(*columns), "searches")
    hits, done, names = [], spark.createDataFrame([], "source_id string, label_rank int, route string"), labels
    while not state.isEmpty():
        size = F.least(_wanted(each, sumstats_only), F.lit(PAGE))
        url = catalogue.page_url(s, F.col("route"), F.col("label"), size.cast("string"), F.col("page").cast("string"), sumstats_only)
        answers = routes.ask(state.select("source_id", F.col("label_rank").cast("long").alias("position"), url.alias("url")))
        of = state.select("source_id", "label_rank", "route", "page").join(answers.select("source_id", F.col("position").cast("int").alias("label_rank"), "status", "body"), ["source_id", "label_rank"])
        mine = ("source_id", "label_rank", "route", "page", "nth")
        items = catalogue.page_items(of, mine[:-1])
        read = catalog.studies_v2(items.filter("route = 'v2'"), keep=mine).unionByName(catalog.studies_v1(items.filter("route = 'v1'"), keep=mine))
        hits.append(keep(read.filter("accession IS NOT NULL"), "hits"))

        sizes = items.groupBy("source_id", "label_rank").agg(F.count("*").alias("n"))
        pages = F.coalesce(F.get_json_object("body", "$.page.totalPages").try_cast("int"), F.lit(0))
        good = F.col("status").between(200, 299) & F.coalesce(F.startswith(F.ltrim("body"), F.lit("{")), F.lit(False))
        told = of.select("source_id", "label_rank", F.coalesce(good, F.lit(False)).alias("good"), F.col("status").isNotNull().alias("answered"), pages.alias("pages"))
        now = state.join(told, ["source_id", "label_rank"]).join(sizes, ["source_id", "label_rank"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        full = (F.col("n") == 0) | (F.col("got") + F.col("n") >= _wanted(each, sumstats_only)) | (F.col("page") + 1 >= F.col("pages"))
        outcome = F.when(F.col("good"), F.when(full, "done").otherwise("more")).when(F.col("route") == "v2", "older").otherwise("failed")
        now = keep(now.withColumns({"outcome": outcome, "sick": F.col("sick") | (~F.col("good") & F.col("answered") & (F.col("route") == "v2"))}), "searches")
        done = keep(done.union(now.filter("outcome = 'done'").select("source_id", "label_rank", "route")), "labels-done")
        have = _kept_hits(reduce(DataFrame.union, hits), done, each, sumstats_only).groupBy("source_id").agg(F.count_distinct("accession").alias("have"))

        same = now.filter("outcome IN ('more', 'older')").withColumns({
            "page": F.when(F.col("outcome") == "more", F.col("page") + 1).otherwise(0), "got": F.when(F.col("outcome") == "more", F.col("got") + F.col("n")).otherwise(0),
            "route": F.when(F.col("outcome") == "more", F.col("route")).otherwise("v1"),
        })
        after = now.filter("outcome IN ('done', 'failed')").select("source_id", (F.col("label_rank") + 1).alias("label_rank"), "sick").join(have, "source_id", "left").filter(F.coalesce("have", F.lit(0)) < enough)
        after = after.join(names, ["source_id", "label_rank"]).withColumns({"route": first_route, "page": F.lit(0), "got": F.lit(0).cast("long")})
        state = keep(same.select(*columns).unionByName(after.select(*columns)), "searches")
    if not hits:
        hits = [catalog.studies_v2(spark.createDataFrame([], "source_id string, label_rank int, route string, page int, nth int, body string"), keep=("source_id", "label_rank", "route", "page", "nth"))]
    return keep(_kept_hits(reduce(DataFrame.union, hits), done, each, sumstats_only).join(names, ["source_id", "label_rank"]), "hits")


def merged(hits: DataFrame) -> DataFrame:
    """One row a search and study: its first place, and all labels that led to it, in order."""
    mine = Window.partitionBy("source_id", "accession")
    first = F.row_number().over(mine.orderBy("position"))
    labels = F.collect_set(F.when(F.col("label").isNotNull(), F.struct("label_rank", "label"))).over(mine)  # no more than there are labels
    marked = hits.withColumns({"nth": first, "matched_traits": F.transform(F.array_sort(labels), lambda x: x["label"])})
    return marked.filter("nth = 1").drop("nth", "label_rank", "label", "route")


def free_text_hits(texts: DataFrame, collected: DataFrame, settings: Settings | Routes, limit: int, sumstats_only: bool) -> DataFrame | None:
    """Studies that the free-text index gives for searches with fewer than ``limit`` (``collected``: ``source_id, accession``).

    Candidates are asked for in order, until a search has twice its limit; those that fail are
    made up for by later ones."""
    routes = routes_of(settings)
    counts = texts.select("source_id").join(collected.groupBy("source_id").agg(F.count("*").alias("have")), "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = keep(counts.filter(F.col("have") < limit), "searches")
    if short.isEmpty():
        return None
    listed = catalogue.text_hits(texts.join(short, "source_id", "left_semi"), routes, limit * 2).filter("resource = 'study' AND accession IS NOT NULL")
    fresh = listed.groupBy("source_id", "accession").agg(F.min("position").alias("position")).join(collected, ["source_id", "accession"], "left_anti")
    pending, found = keep(fresh.join(short, "source_id").withColumnRenamed("have", "at_first"), "pending"), None
    while not pending.isEmpty():
        got = short.select("source_id", F.lit(0).alias("more")) if found is None else found.groupBy("source_id").agg(F.count("*").alias("more"))
        open_now = pending.join(got, "source_id", "left").withColumn("room", F.lit(2 * limit) - F.col("at_first") - F.coalesce("more", F.lit(0)))
        turn = F.row_number().over(Window.partitionBy("source_id").orderBy("position"))
        dealt = keep(open_now.filter("room > 0").withColumn("turn", turn), "pending")
        asked = dealt.filter("turn <= room").select("source_id", "accession", "position")
        studies = catalogue.studies_by_accession(asked.select("accession"), routes).filter("category IS NULL")
        if sumstats_only:
            studies = studies.filter("has_sumstats")
        new = keep(asked.withColumn("_key", F.upper(F.trim("accession"))).drop("accession").join(studies.withColumn("_key", F.col("accession")), "_key").drop("_key", "category"), "hits")
        found = new if found is None else keep(found.unionByName(new), "hits")
        pending = keep(dealt.filter("turn > room").select("source_id", "accession", "position", "at_first"), "pending")
    return found


def search(texts: DataFrame, settings: Settings | Routes, population: str | None = None, limit: int = 25, excludes: list[str] | None = None, sumstats_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best studies for each of ``source_id, text``, and how many each search left out by ``excludes``.

    ``source_id, rank, accession, trait, matched_traits, has_sumstats, year, ancestries, score, total, cases,
    controls, location``: population score, summary statistics and sample size fall, then as they came."""
    routes = routes_of(settings)
    texts = keep(texts.select(F.col("source_id").cast("string").alias("source_id"), "text").filter("text IS NOT NULL").dropDuplicates(["source_id"]), "texts")
    by_label = studies_of_labels(labels_of(texts, routes), routes, limit * 2, limit, sumstats_only)
    by_text = free_text_hits(texts, by_label.select("source_id", "accession").distinct(), routes, limit, sumstats_only)
    hits = by_label
    if by_text is not None:
        hits = hits.unionByName(by_text.withColumn("position", F.col("position") + BEHIND), allowMissingColumns=True)
    studies = keep(routes_to_files.with_sample_counts(merged(hits)), "found")
    out = contains_any(F.col("trait"), discovery.DEFAULT_EXCLUDES if excludes is None else excludes)
    left_out = studies.groupBy("source_id").agg(F.count_if(out).alias("excluded"), F.count("*").alias("of"))
    scored = studies.filter(~out).withColumn("score", match_score(F.lit(population).cast("string"), F.col("ancestries"))["score"]).filter("score > 0")
    n = samples.implied_total(F.col("total"), F.col("cases"), F.col("controls"))
    order = [F.desc("score"), F.desc(F.coalesce("has_sumstats", F.lit(False))), F.desc(F.coalesce(n, F.lit(0))), F.asc("position")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).filter(F.col("rank") <= limit)
    kept = ("source_id", "rank", "accession", "trait", "matched_traits", "has_sumstats", "year", "ancestries", "score", "total", "cases", "controls", "location", "position")
    return ranked.select(*kept), left_out


def run(texts: DataFrame, settings: Settings | Routes, population: str | None = None, limit: int = 10, excludes: list[str] | None = None) -> DataFrame:
    """Search, assess what was found, and order it: ``source_id, place``, the study and its assessment.

    By verdict, sufficient metadata, sample size and year, as ``discovery.rank_candidates`` orders."""
    routes = routes_of(settings)
    found = keep(search(texts, routes, population, limit, excludes, sumstats_only=True)[0], "found")
    assessed = routes_to_files.assess(found.select("accession"), routes).drop("total", "cases", "controls")
    both = found.join(assessed, "accession").withColumns({"api_sufficient": F.col("declared_by").isNotNull(), "n": samples.implied_total(F.col("total"), F.col("cases"), F.col("controls"))})
    return both.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(*discovery.candidate_order()))).drop("position")
