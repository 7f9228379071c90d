"""Queries that apply the operators to the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statsift.functions import cells, names
from statsift.operators import ancestry, archives, catalog, discovery, evaluate, extract, header, mapping, payload, readiness, resolver, samples, validation
from statsift.plans import triage
from statsift.sources.kept import keep
from statsift.vocabulary import CONTAINS_RULES, SUFFIX_RULES, Vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- payloads, names, URLs --------------------------------------------------

_OPENER = " ".join(f"WHEN starts_with(s, {_quoted(o)}) THEN {_quoted(o)}" for o in payload.OPENERS)


@query(
    f"""WITH p AS (SELECT page_id, html, lower(substr(regexp_replace(html, '^[\\x{{FEFF}} \\t\\r\\n]+', ''), 1, {payload.OPENING})) AS s FROM pages),
    q AS (SELECT page_id, CASE {_OPENER} END AS opener, len(regexp_extract_all(substr(html, 1, {payload.SNIFF}), {_quoted(payload.TAG)})) AS tags FROM p)
    SELECT page_id, opener, CAST(tags AS INTEGER) AS tags, CASE WHEN opener IS NOT NULL OR tags >= {payload.LEAST_TAGS} THEN 'NON_DATA' ELSE 'DATA' END AS kind FROM q"""
)
def q01_payload_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a page markup, and why."""
    pages = table(spark, sf_dir, "pages")
    marked = pages.select("page_id", payload.opens_as_markup(F.col("html")).alias("opener"), payload.tag_count(F.col("html")).alias("tags"), payload.markup_reason(F.col("html")).alias("reason"))
    return marked.select("page_id", "opener", "tags", F.when(F.col("reason").isNotNull(), "NON_DATA").otherwise("DATA").alias("kind"))


@query(
    """SELECT page_id, lower(regexp_extract(url, '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS file,
    regexp_matches(url, '(?i)^\\s*(http|https|ftp)://[^/?#:]+') AS direct FROM pages"""
)
def q02_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of addresses."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.url_scheme(url).alias("scheme"), names.url_host(url).alias("host"), names.file_name(url).alias("file"), names.is_direct_url(url).alias("direct"))


_FOLD = cells.FOLDED.replace("'", "''")
_NORMAL = f"regexp_replace(regexp_replace(regexp_replace(lower(x), '{_FOLD}', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(
    f"""WITH t AS (SELECT 'd' || doc_id AS id, string_split(text, chr(10))[1] AS x FROM documents UNION ALL SELECT 'p' || p_partkey, p_name FROM part)
    , u AS (SELECT id, regexp_replace(translate(lower(replace(coalesce(x, ''), chr(65279), '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\x{{0300}}-\\x{{036f}}]', '', 'g') AS x FROM t), v AS (SELECT id, replace(x, 'ß', 'ss') AS x FROM u)
    SELECT id, {_NORMAL} AS name FROM v"""
)
def q03_normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: names in their form for comparison, of all first lines and part names."""
    return _names(spark, sf_dir).select("id", cells.normalised_name(F.col("x")).alias("name"))


@query()
def q03_every_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the same of all first lines and part names, in any alphabet."""
    return _names(spark, sf_dir).select("id", cells.normalised_name(F.col("x")).alias("name"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.element_at(F.split("text", "\n"), 1).alias("x"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("x"))
    return docs.union(parts)


_HEADERS = {
    "lineitem": ["l_orderkey", "BETA", "l_quantity", "P-value", "SE"],
    "meta": ["MarkerName", "Allele1", "Allele2", "Effect", "StdErr", "P-value", "N", "Direction"],
    "plain": ["CHR", "BP", "SNP", "A1", "A2", "OR", "SE", "P"],
    "harmonised": ["hm_chrom", "hm_pos", "hm_rsid", "hm_beta", "hm_effect_allele", "hm_info_score"],
    "odd": ["ID", "ALT", "REF", "study_pval", "joint_beta", "x_odds_ratio_y", "chr", "chr", "color"],
}
_VALUES = ", ".join(f"({_quoted(s)}, {i}, {_quoted(x)})" for s, h in _HEADERS.items() for i, x in enumerate(h))
_VOCABULARY = ", ".join(f"({_quoted(n)}, {_quoted(c)}, {_quoted(m)}, {v}::DOUBLE)" for n, c, _, m, v in Vocabulary().rows())
_RULES = " ".join(
    [f"WHEN ends_with(n, {_quoted(s)}) AND length(n) > {len(s)} THEN {{'c': {_quoted(c)}, 'v': {v}::DOUBLE}}" for s, c, v in SUFFIX_RULES]
    + [f"WHEN contains(n, {_quoted(s)}) THEN {{'c': {_quoted(c)}, 'v': {v}::DOUBLE}}" for s, c, v in CONTAINS_RULES]
)
_MAPPED = f"""raws(source_id, ordinal, x) AS (VALUES {_VALUES}), known(name, concept, method, confidence) AS (VALUES {_VOCABULARY}),
    norm AS (SELECT source_id, ordinal, x AS raw, {_NORMAL} AS n FROM raws),
    ruled AS (SELECT *, CASE {_RULES} END AS r FROM norm),
    mapped AS (SELECT source_id, ordinal, raw, n, coalesce(k.concept, b.concept, r.c, 'unknown') AS concept,
        coalesce(k.method, CASE WHEN b.concept IS NOT NULL OR r IS NOT NULL THEN 'heuristic' ELSE 'unknown' END) AS method,
        coalesce(k.confidence, CASE WHEN b.concept IS NOT NULL THEN 0.9 END, r.v, 0.0)::DOUBLE AS confidence
        FROM ruled LEFT JOIN known k ON n = k.name LEFT JOIN known b ON n LIKE 'hm\\_%' ESCAPE '\\' AND substr(n, 4) = b.name)"""


def _headers(spark: SparkSession) -> DataFrame:
    return mapping.explode_header(spark.createDataFrame(list(_HEADERS.items()), "source_id string, header array<string>"))


@query(f"WITH {_MAPPED} SELECT source_id, ordinal, raw, concept, method, confidence FROM mapped")
def q04_column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered mapping of header names."""
    return mapping.map_columns(_headers(spark)).select("source_id", "ordinal", "raw", "concept", "method", "confidence")


@query(f"""WITH {_MAPPED}, d AS (SELECT source_id, ordinal, n AS normalised, row_number() OVER (PARTITION BY source_id, n ORDER BY ordinal) AS nth FROM mapped)
    SELECT source_id, ordinal, normalised FROM d WHERE nth = 2""")
def q04_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at their second occurrence."""
    return mapping.duplicate_names(mapping.map_columns(_headers(spark))).select("source_id", "ordinal", "normalised")


@query(f"""WITH {_MAPPED}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, concept ORDER BY confidence DESC, ordinal) AS nth, count(*) OVER (PARTITION BY source_id, concept) AS columns FROM mapped WHERE concept <> 'unknown')
    SELECT source_id, concept, ordinal, raw, confidence, columns FROM r WHERE nth = 1""")
def q04_first_for_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the best column of each concept."""
    return mapping.first_for_concept(mapping.map_columns(_headers(spark))).select("source_id", "concept", "ordinal", "raw", "confidence", "columns")


# --- lines and delimiters ---------------------------------------------------

_LINES = """raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    cut AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM raw),
    lines AS (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line_idx, unnest(parts) AS line FROM cut),
    marked AS (SELECT *, trim(line, ' ' || chr(9)) AS bare, regexp_matches(line, '^\\s*(#|!|;;|//)') AS comment FROM lines)"""


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header.explode_lines(_document_texts(spark, sf_dir))


def _document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


@query(
    f"""WITH {_LINES}, first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS nth FROM marked WHERE bare <> '' AND NOT comment),
    delims(o, d) AS (VALUES (0, chr(9)), (1, ','), (2, ';'), (3, ' '), (4, '|')),
    sized AS (SELECT doc_id, o, d, line_idx, CASE WHEN d = ' ' THEN len(regexp_split_to_array(bare, '\\s+')) ELSE len(string_split(CASE WHEN contains(line, '"') THEN regexp_replace(line, '(^|' || CASE d WHEN '|' THEN '\\|' ELSE d END || ') *"(?:[^"]|"")*(?:"[^' || d || ']*)?', '\\1q', 'g') ELSE line END, d)) END AS fields FROM first, delims WHERE nth <= 20),
    counts AS (SELECT doc_id, o, d, fields, count(*) AS n, min(line_idx) AS seen FROM sized GROUP BY ALL),
    modal AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, o) AS total, row_number() OVER (PARTITION BY doc_id, o ORDER BY n DESC, seen) AS mode FROM counts),
    scored AS (SELECT *, 10 * (n / total) + 0.1::DOUBLE * least(fields, 30) + CASE WHEN o = 0 THEN 0.35::DOUBLE ELSE 0 END AS score FROM modal WHERE mode = 1 AND fields > 1),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS nth FROM scored)
    SELECT doc_id, d AS delimiter, CAST(fields AS INTEGER) AS fields, round(n / total, 4) AS confidence FROM best WHERE nth = 1"""
)
def q05_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delimiter on which the first lines agree."""
    return header.delimiters_of_texts(_document_texts(spark, sf_dir)).withColumnRenamed("source_id", "doc_id")


@query()
def q05_every_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all documents, quoted cells included."""
    return header.delimiters_of_texts(_document_texts(spark, sf_dir)).withColumnRenamed("source_id", "doc_id")


@query(
    f"""WITH {_LINES}, rows AS (SELECT doc_id, line_idx, len(regexp_split_to_array(bare, '\\s+')) AS fields, bare = '' AS blank, bare <> '' AND NOT comment AS usable,
        len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda v: regexp_matches(v, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'))) AS numeric FROM marked),
    ahead AS (SELECT *, array_agg({{'u': usable, 'f': fields}}) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS nxt, fields AS mine FROM rows)
    SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, CAST(fields AS INTEGER) AS fields, CAST(numeric AS INTEGER) AS numeric,
        CAST(coalesce(len(list_filter(nxt, lambda r: r.u)), 0) AS INTEGER) AS following, CAST(coalesce(len(list_filter(nxt, lambda r: r.u AND r.f = mine)), 0) AS INTEGER) AS same_arity FROM ahead WHERE NOT blank"""
)
def q06_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field counts, numbers, and the arity of the next seven physical lines."""
    return _look_ahead(_document_lines(spark, sf_dir))


@query()
def q06_every_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all documents, quoted cells included."""
    return _look_ahead(_document_lines(spark, sf_dir))


def _look_ahead(lines: DataFrame) -> DataFrame:
    split = header.split_line(F.col("line"), F.lit(" "))
    blank = cells.trimmed(F.col("line")) == ""
    rows = lines.withColumns({"cells": split, "blank": blank, "usable": ~blank & ~header.is_comment(F.col("line"))}).withColumn("fields", F.size("cells"))
    ahead = Window.partitionBy("source_id").orderBy("line_idx").rowsBetween(1, header.LOOK_AHEAD)
    rows = rows.withColumn("next", F.filter(F.collect_list(F.struct("usable", "fields")).over(ahead), lambda r: r["usable"]))
    return rows.filter("NOT blank").select(
        F.col("source_id").alias("doc_id"), "line_idx", "fields", F.size(F.filter("cells", cells.is_numeric_cell)).alias("numeric"),
        F.size("next").alias("following"), F.size(F.filter("next", lambda r: r["fields"] == F.col("fields"))).alias("same_arity"),
    )


# --- values -----------------------------------------------------------------


@query(
    """WITH c AS (SELECT l_returnflag, unnest(['p_value', 'effect_allele_frequency', 'sample_size', 'minor_allele_frequency', 'info_score']) AS concept,
        unnest([l_discount, l_tax, l_quantity, l_discount * 10, l_quantity / 20]) AS x FROM lineitem),
    v AS (SELECT l_returnflag, concept, CASE concept WHEN 'sample_size' THEN x > 0 WHEN 'minor_allele_frequency' THEN x BETWEEN -0.001 AND 0.501 WHEN 'info_score' THEN x BETWEEN 0 AND 2 ELSE x BETWEEN 0 AND 1 END AS ok FROM c),
    g AS (SELECT l_returnflag, concept, count(*) AS tested, count_if(ok) AS valid FROM v GROUP BY ALL)
    SELECT l_returnflag, concept, tested, CAST(valid AS BIGINT) AS valid, CASE WHEN valid / tested >= 0.95 THEN 'PASS' WHEN valid / tested >= 0.8 THEN 'WARN' ELSE 'FAIL' END AS status FROM g"""
)
def q07_value_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of columns against their concepts' domains."""
    columns = {"p_value": F.col("l_discount"), "effect_allele_frequency": F.col("l_tax"), "sample_size": F.col("l_quantity"), "minor_allele_frequency": F.col("l_discount") * 10, "info_score": F.col("l_quantity") / 20}
    tall = table(spark, sf_dir, "lineitem").select("l_returnflag", F.inline(F.array(*(F.struct(F.lit(k).alias("concept"), v.cast("string").alias("cell")) for k, v in columns.items()))))
    numbered = tall.withColumn("number", cells.finite(F.col("cell")))
    counts = numbered.groupBy("l_returnflag", "concept").agg(F.count("*").alias("tested"), F.count_if(validation.is_valid(F.col("concept"), F.col("cell"), F.col("number"))).alias("valid"))
    return counts.withColumn("status", validation.status_of(F.col("valid") / F.col("tested")))


@query(
    """SELECT l_linestatus, count(*) AS n, CAST(count_if(upper(trim(l_returnflag)) = upper(trim(l_linestatus))) AS BIGINT) AS equal,
    CAST(count_if(l_quantity > 0 AND abs(l_discount * l_quantity + l_tax * l_quantity - l_quantity) / l_quantity > 0.9) AS BIGINT) AS off FROM lineitem GROUP BY l_linestatus"""
)
def q08_cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal partners, and parts that do not add up."""
    q = F.col("l_quantity")
    equal = F.upper(cells.trimmed(F.col("l_returnflag"))) == F.upper(cells.trimmed(F.col("l_linestatus")))
    off = (q > 0) & (F.abs(F.col("l_discount") * q + F.col("l_tax") * q - q) / q > 0.9)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(equal).alias("equal"), F.count_if(off).alias("off"))


@query(
    """WITH t AS (SELECT conv_id, turn, trim(text) AS x, regexp_extract(text, '(\\d{1,3}(?:[,   ]\\d{3})+|\\d+)', 1) AS n FROM conversations)
    SELECT conv_id, turn, CASE WHEN NOT regexp_matches(x, '\\d[.eE]\\d|\\d[eE][+-]\\d') AND n <> '' THEN TRY_CAST(regexp_replace(n, '[,   ]', '', 'g') AS BIGINT) END AS n FROM t"""
)
def q09_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first whole number of a text, unless it holds a decimal."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cells.parse_count(F.col("text")).alias("n"))


@query(
    """WITH g AS (SELECT c_nationkey, count_if(c_acctbal > 5000) AS a FROM customer GROUP BY c_nationkey)
    SELECT c_nationkey, CAST(CASE WHEN a > 0 THEN a END AS BIGINT) AS cases, CAST(CASE WHEN a > 0 THEN 0.9 END AS DOUBLE) AS cases_confidence, CAST(NULL AS BIGINT) AS controls, CAST(NULL AS DOUBLE) AS controls_confidence,
    CAST(NULL AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS total_confidence FROM g"""
)
def q09_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and controls of descriptions made of customer counts; the variants behind the controls rule those out."""
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("a"), F.count_if(F.col("c_acctbal") <= 5000).alias("b"))
    text = F.concat(F.format_number("a", 0), F.lit(" European ancestry cases, "), F.format_number("b", 0), F.lit(" European ancestry controls, 500 variants"))
    return sizes.select("c_nationkey", samples.count_from_text(text).alias("s")).select("c_nationkey", "s.*")


@query("SELECT p_partkey, p_type FROM part WHERE NOT (contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small'))")
def q10_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds none of the parts."""
    kept, _ = discovery.exclude(table(spark, sf_dir, "part"), ["PROMO", " small "], "p_type")
    return kept.select("p_partkey", "p_type")


@query("SELECT CAST(count_if(contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small')) AS BIGINT) AS excluded, count(*) AS of FROM part")
def q10_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an exclusion dropped."""
    return discovery.exclude(table(spark, sf_dir, "part"), ["PROMO", " small "], "p_type")[1]


_TERMS = " ".join(f"WHEN contains(w, {_quoted(t)}) THEN {_quoted(c)}" for t, c in sorted(ancestry.terms().items(), key=lambda x: -len(x[0])))
_EXACT = " ".join(f"WHEN {_quoted(t)} THEN {_quoted(c)}" for t, c in ancestry.terms().items())


@query(f"""WITH t AS (SELECT n_nationkey, lower(trim(r_name || CASE n_nationkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN ' american indian' ELSE '' END)) AS w FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT n_nationkey, coalesce(CASE w {_EXACT} END, CASE {_TERMS} END) AS category FROM t""")
def q11_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the category of a term, or of the longest term within a text."""
    k = F.col("n_nationkey")
    word = F.concat("r_name", F.when(k % 3 == 0, "n").when(k % 3 == 1, " american indian").otherwise(""))
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", ancestry.normalised(word).alias("category"))


# --- ranking ----------------------------------------------------------------


@query(
    """SELECT o_orderkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ORDER BY n_regionkey DESC, (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey LIMIT 50"""
)
def q12_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the best rows by three keys."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.orderBy(F.desc("n_regionkey"), F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "n_name", "o_totalprice")


@query(
    """WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER w AS nth, lead(s_acctbal) OVER w AS nxt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))
    SELECT s_nationkey, s_suppkey, round(s_acctbal - nxt, 6) AS gap FROM r WHERE nth = 1"""
)
def q13_best_with_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group and its lead."""
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    ranked = table(spark, sf_dir, "supplier").withColumns({"nth": F.row_number().over(order), "next": F.lead("s_acctbal").over(order)})
    return ranked.filter("nth = 1").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") - F.col("next"), 6).alias("gap"))


@query(
    """WITH h AS (SELECT c_custkey AS accession, c_mktsegment AS trait, 0 AS search FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'nation' || c_nationkey, 1 FROM customer WHERE c_nationkey < 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY search) AS nth, list_sort(list(trait) OVER (PARTITION BY accession)) AS traits FROM h)
    SELECT accession, trait, array_to_string(traits, '|') AS traits FROM r WHERE nth = 1"""
)
def q14_merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two searches, the first one's row, all traits."""
    c = table(spark, sf_dir, "customer")
    a = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("accession"), F.col("c_mktsegment").alias("trait"), F.col("c_custkey").alias("position"))
    b = c.filter("c_nationkey < 8").select(F.col("c_custkey").alias("accession"), F.concat(F.lit("nation"), F.col("c_nationkey")).alias("trait"), F.col("c_custkey").alias("position"))
    return discovery.merge_hits(a, b).select("accession", "trait", F.array_join("traits", "|").alias("traits"))


# --- evaluation -------------------------------------------------------------

_RATES = """round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(tp / nullif(tp + fn, 0), 4) AS sensitivity, round(tn / nullif(tn + fp, 0), 4) AS specificity,
    round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 4) AS accuracy, round(fp / nullif(fp + tn, 0), 4) AS fpr, round(fn / nullif(fn + tp, 0), 4) AS fnr"""


@query(
    f"""WITH g AS (SELECT CAST(count_if(toxic = 1 AND quality = 0) AS BIGINT) AS tp, CAST(count_if(toxic = 1 AND quality <> 0) AS BIGINT) AS fp,
    CAST(count_if(toxic <> 1 AND quality <> 0) AS BIGINT) AS tn, CAST(count_if(toxic <> 1 AND quality = 0) AS BIGINT) AS fn FROM labels) SELECT *, {_RATES} FROM g"""
)
def q15_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-way decision with all its rates."""
    return evaluate.confusion(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query(
    """WITH s AS (SELECT user_id % 10 AS k, event_type AS name, count_if(user_id % 20 < 10) AS said, count_if(user_id % 20 >= 10) AS truth FROM events GROUP BY ALL),
    g AS (SELECT CAST(sum(least(said, truth)) AS BIGINT) AS tp, CAST(sum(greatest(said - truth, 0)) AS BIGINT) AS fp, CAST(sum(greatest(truth - said, 0)) AS BIGINT) AS fn FROM s)
    SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM g"""
)
def q16_column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of multisets."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_type").alias("name"), (F.col("user_id") % 20 < 10).alias("first"))
    return evaluate.column_set_scores(e.filter("first"), e.filter("NOT first"))


@query(
    """SELECT lang, count(*) AS n, CAST(sum(least(n_chars, 1000)) AS BIGINT) AS received, CAST(sum(n_chars) AS BIGINT) AS whole, round(100 * (1 - sum(least(n_chars, 1000)) / sum(n_chars)), 4) AS reduction_percent,
    round(avg(least(n_chars, 1000)), 4) AS mean_received, CAST(median(least(n_chars, 1000)) AS DOUBLE) AS median_received FROM documents GROUP BY lang"""
)
def q17_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prefix of 1,000 saves."""
    docs = table(spark, sf_dir, "documents").withColumn("got", F.least("n_chars", F.lit(1000)))
    return evaluate.transfer_totals(docs, "got", "n_chars", ["lang"])


@query("SELECT event_type AS actual, CASE user_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'UNKNOWN' END AS guess, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def q18_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of labels and guesses, no guess being UNKNOWN."""
    k = F.col("user_id") % 3
    return evaluate.agreement(table(spark, sf_dir, "events").withColumn("said", F.when(k == 0, "click").when(k == 1, "view")), "said", "event_type")


@query(
    """SELECT CAST(grouping(event_type) AS TINYINT) AS overall, event_type AS true, count(*) AS n, round(count_if(event_type = CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END) / count(*), 4) AS accuracy
    FROM events WHERE event_type IS NOT NULL GROUP BY GROUPING SETS ((), (event_type))"""
)
def q18_mapping_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all and for each concept."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "click").otherwise("view").alias("said"), F.col("event_type").alias("true"))
    return evaluate.mapping_accuracy(e)


@query(
    """WITH g AS (SELECT grouping(l_returnflag) AS a, grouping(l_linestatus) AS b, l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus)))
    SELECT CASE WHEN a = 0 THEN 'l_returnflag' WHEN b = 0 THEN 'l_linestatus' ELSE 'all' END AS stratum, CASE WHEN a = 0 THEN l_returnflag WHEN b = 0 THEN l_linestatus END AS value, n, quantity FROM g"""
)
def q19_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the same measures over all rows and for each value of each key."""
    return evaluate.stratified(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")])


@query(
    """WITH t AS (SELECT doc_id, s AS probe_bytes, substr(text, 1, s) AS x FROM documents, (VALUES (64), (256), (1024), (4096), (16384)) v(s)),
    h AS (SELECT doc_id, probe_bytes, CASE WHEN contains(x, chr(10)) THEN string_split(x, chr(10))[1] END AS header, length(x) AS got FROM t),
    r AS (SELECT *, max_by(header, probe_bytes) FILTER (header IS NOT NULL) OVER (PARTITION BY doc_id) AS ref FROM h)
    SELECT probe_bytes, count(DISTINCT doc_id) AS sources, round(count(header) / count(*), 4) AS detection_rate,
    round(count_if(ref IS NOT NULL AND coalesce(header = ref, false)) / nullif(count(ref), 0), 4) AS agreement, round(avg(got), 4) AS mean_bytes FROM r GROUP BY probe_bytes"""
)
def q20_probe_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that prefixes of five sizes recover."""
    sizes = F.array(*map(F.lit, (64, 256, 1024, 4096, 16384)))
    end = F.locate("\n", "text")  # the first line ends here; 0: nowhere
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.length("text").alias("chars"), end.alias("end"), F.when(end > 0, F.substring("text", F.lit(1), end - 1)).alias("line"))
    trials = docs.select("source_id", "chars", "end", "line", F.explode(sizes).alias("probe_bytes"))
    first = F.when((F.col("end") > 0) & (F.col("end") <= F.col("probe_bytes")), F.col("line"))
    return evaluate.probe_size_sweep(trials.select("source_id", "probe_bytes", first.alias("header"), F.least("chars", "probe_bytes").alias("bytes_read")))


@query("SELECT event_id, array_to_string(list_filter(json_keys(props), lambda k: NOT starts_with(k, '_')), '|') AS fields FROM events")
def q21_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names of JSON records."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(catalog.record_fields(F.col("props")), "|").alias("fields"))


@query(
    """WITH k AS (SELECT c_custkey, printf('%06d', c_custkey * 37 + 1) AS d, c_custkey * 37 + 1 AS n, CASE c_custkey % 5 WHEN 0 THEN '-' WHEN 1 THEN c_custkey || '.5K' WHEN 2 THEN c_custkey || 'M' WHEN 3 THEN (c_custkey % 9) || '.25G' ELSE c_custkey || '' END AS label FROM customer)
    SELECT c_custkey, 'GCST' || repeat('0', CAST(greatest(0, length(d) - length(CAST((n - 1) // 1000 * 1000 + 1 AS VARCHAR))) AS INTEGER)) || ((n - 1) // 1000 * 1000 + 1) || '-GCST' || repeat('0', CAST(greatest(0, length(d) - length(CAST((n - 1) // 1000 * 1000 + 1000 AS VARCHAR))) AS INTEGER)) || ((n - 1) // 1000 * 1000 + 1000) AS block,
    CASE WHEN label <> '-' THEN CAST(trunc(CAST(regexp_extract(label, '([0-9.]+)', 1) AS DOUBLE) * CASE right(label, 1) WHEN 'K' THEN 1024.0 WHEN 'M' THEN 1048576.0 WHEN 'G' THEN 1073741824.0 ELSE 1 END) AS BIGINT) END AS size FROM k"""
)
def q22_blocks_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folders of accessions, bytes of size labels."""
    k = F.col("c_custkey")
    label = F.when(k % 5 == 0, "-").when(k % 5 == 1, F.concat(k, F.lit(".5K"))).when(k % 5 == 2, F.concat(k, F.lit("M"))).when(k % 5 == 3, F.concat(k % 9, F.lit(".25G"))).otherwise(k.cast("string"))
    accession = F.format_string("GCST%06d", (k * 37 + 1).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.accession_block(accession).alias("block"), names.parse_size_label(label).alias("size"))


_DNF = ", ".join(f"({_quoted(r)}, {str(q).lower()}, {i}, {len(g)}, {_quoted(c)})" for r, q, gs in readiness.RULES for i, g in enumerate(gs) for c in g)


@query(
    f"""WITH {_MAPPED}, rules(requirement, required, option, size, concept) AS (VALUES {_DNF}),
    best AS (SELECT source_id, concept, max(confidence) AS confidence FROM mapped WHERE concept <> 'unknown' GROUP BY ALL),
    opts AS (SELECT source_id, requirement, option, size, count(*) AS have, min(confidence) AS confidence FROM best JOIN rules USING (concept) GROUP BY ALL),
    won AS (SELECT source_id, requirement, max(confidence) AS confidence FROM opts WHERE have = size GROUP BY ALL),
    every AS (SELECT DISTINCT source_id, requirement FROM mapped, rules WHERE required),
    res AS (SELECT source_id, requirement, coalesce(confidence, 0) AS confidence FROM every LEFT JOIN won USING (source_id, requirement)),
    g AS (SELECT source_id, count_if(confidence < 0.5) AS m, count_if(confidence >= 0.5 AND confidence < 0.9) AS u, min(CASE WHEN confidence > 0 THEN confidence END) AS confidence FROM res GROUP BY source_id)
    SELECT source_id, CAST(m AS BIGINT) AS n_missing, CAST(u AS BIGINT) AS n_uncertain, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN m = 0 AND u = 0 THEN 'READY' WHEN m <= 2 THEN 'PARTIAL' ELSE 'NOT_READY' END AS verdict FROM g"""
)
def q23_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules folded into verdicts."""
    return readiness.assess(mapping.map_columns(_headers(spark))).select("source_id", "n_missing", "n_uncertain", "confidence", "verdict")


@query(
    """SELECT doc_id, quality = 1 AS is_ssf, coalesce(NOT (quality = 1), true) AS probe_needed, coalesce(n_chars, quality + toxic) AS implied
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def q24_tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown is not no, but an unknown status needs a probe."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    declared = d.withColumn("file_type", F.when(F.col("quality") == 1, "GWAS-SSF v1").when(F.col("quality") == 0, "pre"))
    out = readiness.needs_probe(declared)
    return out.select("doc_id", "is_ssf", "probe_needed", samples.implied_total(F.col("n_chars"), F.col("quality").cast("long"), F.col("toxic").cast("long")).alias("implied"))


@query(
    """WITH x AS (SELECT CASE doc_id % 3 WHEN 0 THEN '"' || lang || '"' WHEN 1 THEN ' ' || lang ELSE lang END AS lang, CASE doc_id % 2 WHEN 0 THEN source || ' ' ELSE source END AS source FROM documents)
    SELECT 'strip_white_space' AS name, 'lang' AS "column", CAST(count_if(lang <> trim(lang)) AS BIGINT) AS rows_affected FROM x UNION ALL SELECT 'strip_white_space', 'source', CAST(count_if(source <> trim(source)) AS BIGINT) FROM x
    UNION ALL SELECT 'strip_quotes', 'lang', CAST(count_if(regexp_full_match(trim(lang), '".*"')) AS BIGINT) FROM x"""
)
def q25_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a clean-up changed."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    padded = docs.select(F.when(k % 3 == 0, F.concat(F.lit('"'), "lang", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang")).alias("lang"), F.when(k % 2 == 0, F.concat("source", F.lit(" "))).otherwise(F.col("source")).alias("source"))
    return extract.clean(padded)[1]


@query("SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY md5(text)")
def q26_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums and groups of equal contents."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def q27_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment that leaves NULL where nothing is known."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q27_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is absent."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT item_id FROM benchmark WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = item_id)")
def q27_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is present."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(labels, "item_id", "left_semi")


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY event_type")
def q28_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by frequency."""
    return evaluate.failure_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("position")))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'non' WHEN c_mktsegment = 'BUILDING' THEN 'GWAS-SSF' ELSE c_mktsegment END AS ssf,
    CASE c_custkey % 6 WHEN 0 THEN 'api_deprecated' WHEN 1 THEN 'http_404' WHEN 2 THEN 'http_403' WHEN 3 THEN 'http_error' WHEN 4 THEN 'range_not_supported' END AS category FROM customer"""
)
def q29_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and HTTP statuses."""
    k, segment = F.col("c_custkey") % 6, F.col("c_mktsegment")
    declared = F.when(segment == "FURNITURE", "non").when(segment == "BUILDING", " gwas-ssf v0.1").otherwise(segment)
    status = F.when(k == 0, 410).when(k == 1, 404).when(k == 2, 403).when(k == 3, 500).when(k == 4, 416).otherwise(200)
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.ssf_status(declared).alias("ssf"), names.status_category(status).alias("category"))


_KINDS = ("sumstats.tsv.gz", "readme.txt", "md5sum.txt", "GCST000001-meta.yaml", "paper.pdf", "harmonised/", "x.h.tsv.gz", "table.zip")
_KIND_SQL = " ".join(f"WHEN {i} THEN {_quoted(k)}" for i, k in enumerate(("data", "readme", "checksum", "metadata", "auxiliary", "directory", "data", "data")))


@query(f"SELECT p_partkey, CASE p_partkey % 8 {_KIND_SQL} END AS kind FROM part")
def q30_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file's name says it is."""
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.file_kind(name).alias("kind"))


@query(
    """WITH e AS (SELECT p_brand AS source_id, p_partkey AS ordinal, p_partkey % 8 AS k, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS size FROM part WHERE p_partkey % 8 IN (0, 6, 7)),
    s AS (SELECT *, CASE k WHEN 0 THEN -1 + 3 WHEN 6 THEN 6 + 5 + 3 ELSE -1 + 0.5 END + CASE WHEN size = 0 THEN -10 ELSE least(1.5, log10(size) / 6) END AS score FROM e),
    r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, ordinal))
    SELECT source_id, CASE k WHEN 0 THEN 'sumstats.tsv.gz' WHEN 6 THEN 'x.h.tsv.gz' ELSE 'table.zip' END AS name, size, round(score, 6)::DOUBLE AS score, round(score - nxt, 6)::DOUBLE AS gap FROM r WHERE nth = 1"""
)
def q31_best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file of each listing, with its lead."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 8 + 1).cast("int"))
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), k.alias("ordinal"), name.alias("name"), (F.col("p_retailprice") * 1000).cast("long").alias("size"), (k % 8 == 6).alias("harmonised"), F.lit("GCST000001").alias("accession"))
    return resolver.resolve_files(entries)


#: Rows of a table that make one file.
_FILE_ROWS = 200


def _tables_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tab-separated files with a preamble: a file for each nation and block of ids, of a bounded number of rows."""
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws("\t", F.concat(F.lit("rs"), "c_custkey"), (F.col("c_nationkey") % 22 + 1).cast("string"), (F.col("c_custkey") + 1).cast("string"), F.lit("A"), F.lit("G"), F.format_number(F.col("c_acctbal") / 10000, 4), F.lit("0.01"), F.format_string("%.3f", F.col("c_custkey") % 1000 / 1000))
    source = F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / (25 * _FILE_ROWS)))
    rows = c.groupBy(source.alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))  # a block has 25 times that many ids, dealt over 25 nations
    head = "# customers\n# as a table\nSNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n"
    return rows.select("source_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


@query()
def q32_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to verdicts, the flagship job."""
    return triage.scan_texts(_tables_as_files(spark, sf_dir)).select("source_id", "header_row", "delimiter", F.array_join("header", "|").alias("header"), "confidence", "verdict")


@query(
    """WITH l AS (SELECT c_nationkey || '-' || (c_custkey // 5000) AS source_id, length('rs' || c_custkey) + length(CAST(c_nationkey % 22 + 1 AS VARCHAR)) + length(CAST(c_custkey + 1 AS VARCHAR))
        + length(printf('%.4f', c_acctbal / 10000)) + length('A') + length('G') + length('0.01') + length('0.123') + 7 AS chars FROM customer)
    SELECT source_id, 'DATA' AS kind, 'gzip' AS compression, 'ascii' AS encoding, CAST(sum(chars + 1) + length('# customers') + 1 + length('# as a table') + 1 + length('SNP CHR BP A1 A2 BETA SE P') + 1 AS INTEGER) AS chars FROM l GROUP BY source_id"""
)
def q33_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables' files packed by gzip and read back from their bytes."""
    import gzip

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: gzip.compress(t.encode(), mtime=0))

    files = _tables_as_files(spark, sf_dir).select("source_id", F.lit("x.tsv.gz").alias("name"), packed("text").alias("content"), F.lit(None).cast("string").alias("content_type"), F.lit(0).cast("long").alias("size"))
    return triage.decode_prefixes(files).select("source_id", "kind", "compression", "encoding", F.length("text").alias("chars"))


@query(
    """SELECT doc_id, CAST(4 AS BIGINT) AS members, 'results/data-' || doc_id || '.tsv' AS member, sha256(coalesce(text, '')) AS sha256, CAST(NULL AS VARCHAR) AS category FROM documents"""
)
def q34_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a member of a zip file, found by the central directory and read from its own range."""
    import io
    import zipfile

    def one(k: int, t: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("README.md", "about")
            z.writestr(zipfile.ZipInfo("notes.pdf"), "x" * 2000)
            z.writestr(f"results/data-{k}.tsv", t)
            z.writestr("z.out", "later")
        return out.getvalue()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in archives.pieces(batches, "text"):
            keys = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys]), pa.array([one(k, t) for k, t in zip(keys, part.column("text").to_pylist())], pa.binary())], ["source_id", "zip"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    zips = keep(docs.mapInArrow(packed, "source_id string, zip binary"), "zips")  # read twice below
    size = F.octet_length("zip").cast("long")
    tails = zips.select("source_id", F.substring("zip", -archives.TAIL_BYTES, archives.TAIL_BYTES).alias("tail"), size.alias("size"))
    members = archives.members(tails)
    chosen = archives.pick(members).join(members.groupBy("source_id").agg(F.count("member").alias("members")), "source_id")
    chunks = chosen.join(zips, "source_id").withColumn("content", F.substring("zip", F.col("offset").cast("int") + 1, (F.col("packed") + archives.LOCAL_SIZE + 1024).cast("int")))
    read = archives.member_prefixes(chunks, 64 << 20)
    out = read.join(chosen.select("source_id", "members"), "source_id")
    return out.select(F.col("source_id").cast("long").alias("doc_id"), "members", "member", F.sha2("data", 256).alias("sha256"), "category")


_WRITTEN = "\\x00-\\x7f\\xa0-\\xff"


@query(
    f"""SELECT doc_id, CASE WHEN regexp_full_match(text, '[\\x00-\\x7f]*') THEN 'ascii' ELSE 'cp1252' END AS encoding, sha256(text || chr(10) || 'the end' || chr(10)) AS sha256
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_full_match(text, '[{_WRITTEN}]*')"""
)
def q35_character_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that Latin letters alone can write, as bytes of an older character set and back."""

    @F.pandas_udf("binary")
    def encoded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t.encode("cp1252", "replace"))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~F.col("text").rlike(f"[^{_WRITTEN}]"))
    read = docs.select("doc_id", payload.decode_text(encoded(F.concat("text", F.lit("\nthe end\n")))).alias("d"))
    return read.select("doc_id", F.col("d.encoding").alias("encoding"), F.sha2(F.col("d.text").cast("binary"), 256).alias("sha256"))
