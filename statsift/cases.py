"""Queries that hold single operators against values written by hand.

Each takes its inputs from whole tables: a row's key picks one of the cases.  The
SQL has the expected values as literals, so nothing in it comes from the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift.functions import cells, manifest, names
from statsift.operators import ancestry, catalog, discovery, evaluate, header, mapping, payload, readiness, resolver, samples, validation
from statsift.queries import QUERIES, SQL, query, table
from statsift.sources.kept import keep, spread

Value = str | int | float | bool | list | None


def _sql(value: Value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]"
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\t")]
    return " || chr(9) || ".join(p.replace("\n", "' || chr(10) || '") for p in parts)


def _lit(value: Value) -> Column:
    return F.array(*map(_lit, value)) if isinstance(value, list) else F.lit(value)


def nth(key: Column, values: list[Value], kind: str) -> Column:
    """The value that a key picks, going round."""
    return F.element_at(F.array(*(_lit(v).cast(kind) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def nth_sql(key: str, values: list[Value], kind: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values))
    return f"CAST(CASE {key} % {len(values)} {whens} END AS {kind})"


DUCK = {"string": "VARCHAR", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE"}


def cases(name: str, about: str, function: Callable[[Column], Column], pairs: list[tuple[Value, Value]], given: str = "string", out: str = "string") -> None:
    """Register ``name``: ``function`` over a part's case, with the expected values as SQL."""
    inputs, expected = [p[0] for p in pairs], [p[1] for p in pairs]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("p_partkey")
        picked = table(spark, sf_dir, "part").select("p_partkey", nth(key, inputs, given).alias("given"))
        return picked.select("p_partkey", function(F.col("given")).cast(out).alias("result"))

    run.__name__, run.__doc__ = name, about
    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey, {nth_sql('p_partkey', expected, DUCK[out])} AS result FROM part"


# --- cells ------------------------------------------------------------------

cases("c_missing", "F1: missing markers of values.", cells.is_missing, [("NA", True), (" na ", True), (".", True), ("-", True), ("NaN", True), ("0", False), ("", True), ("N/A", True), ("none", True), ("1.5", False), ("nd", True), ("?", True), ("#NA", True), ("null", True), ("<NA>", True)], out="boolean")
cases("c_missing_in_headers", "F1: missing markers of header work.", cells.looks_like_missing, [("nd", False), ("?", False), ("NA", True), ("", True), ("-", True), ("x", False), ("None", True)], out="boolean")
cases("c_numeric_cell", "F2: plain numbers that are not missing markers.", cells.is_numeric_cell, [("1", True), ("-1.5e-3", True), (".5", True), ("5.", True), ("+2", True), ("nan", False), ("abc", False), ("1,000", False), ("", False), ("1e", False)], out="boolean")
cases("c_number_in_header", "H10: what counts as a number in a header line.", cells.reads_as_number, [("nan", True), ("inf", True), ("-Infinity", True), ("1e5", True), (" 7 ", True), ("abc", False), ("", False), ("5.", True), ("1.2.3", False)], out="boolean")
cases("c_finite", "F2: finite numbers.", cells.finite, [("1.5", 1.5), ("-2", -2.0), ("1e999", None), ("nan", None), ("x", None), (" 3e2 ", 300.0)], out="double")
cases("c_counts", "F3: whole numbers with separators.", cells.parse_count, [("12,345 people", 12345), ("n=500", 500), ("1.5", None), ("2e+5", None), ("none", None), ("1 234 567", 1234567), ("007", 7)], out="bigint")
cases("c_flags", "F4: words for yes and no.", cells.as_flag, [("yes", True), ("No", False), ("TRUE", True), ("0", False), ("maybe", None), ("", None), (" Y ", True)], out="boolean")
cases("c_integers", "F4: whole numbers.", cells.as_int, [("12", 12), (" 7 ", 7), ("x", None), ("", None), ("-3", -3)], out="bigint")
cases("c_years", "F4: the year of a date.", cells.year_of, [("2019-05-01", 2019), ("1998", 1998), ("none", None), ("", None)], out="bigint")
cases("c_blank_to_null", "F4: missing markers of the catalogue.", cells.blank_to_null, [("NR", None), (" NA ", None), ("", None), ("x ", "x"), ("none", None)])
cases("c_transfer_reduction", "S4: the share of a file that was not read.", lambda v: cells.transfer_reduction(F.lit(256), v), [(1024, 0.75), (256, 0.0), (100, 0.0), (0, None), (None, None)], given="bigint", out="double")
cases("c_data_rows", "H10, H11: lines that look like data.", lambda v: cells.is_data_row(F.split(v, ",")), [("1,2,3", True), ("a,b,c", False), ("rs1,1,2", True), ("rs1,A,G,NA,0.5", False), (",,", False), ("1,,", True)], out="boolean")

# --- names and addresses ----------------------------------------------------

cases("c_accessions", "F5: accessions.", names.is_accession, [("GCST90038646", True), ("gcst0001", True), ("GCST12", False), ("XGCST0001", False), ("GCST0001x", False)], out="boolean")
cases("c_human_sizes", "F8: bytes for people.", names.human_size, [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1048576, "1.00 MB"), (5368709120, "5.00 GB"), (None, "unknown")], given="bigint")
cases("c_strip_packed", "F9: names without a compression suffix.", names.strip_packed, [("a.tsv.gz", "a.tsv"), ("a.TAR.GZ", "a"), ("b.csv.bz2", "b.csv"), ("c.txt", "c.txt"), ("d.zip", "d")])
cases("c_inner_extensions", "F9: the extension below the compression.", names.inner_extension, [("a.tsv.gz", ".tsv"), ("b.CSV", ".csv"), ("c", ""), ("x.y.txt.xz", ".txt")])
cases("c_delimiter_for", "F9: the delimiter of an extension.", names.delimiter_for, [("a.csv.gz", ","), ("a.tsv", "\t"), ("a.tab.bz2", "\t"), ("a.txt", None)])
cases("c_url_hosts", "F10: hosts of addresses.", names.url_host, [("https://Host.org/a", "host.org"), ("ftp://u:p@h.net:21/x", "h.net"), ("no url", ""), ("http://h?x=1", "h")])
cases("c_mirrors", "F11: ftp becomes https where a mirror is known.", names.normalised_url, [("ftp://ftp.ebi.ac.uk/a/b.gz", "https://ftp.ebi.ac.uk/a/b.gz"), ("https://x.org/a", "https://x.org/a"), ("ftp://unknown.example/a", None)])
cases("c_share_links", "F12: share pages as downloads.", names.share_url, [("https://www.dropbox.com/s/k/a.tsv?dl=0", "https://www.dropbox.com/s/k/a.tsv?dl=1"), ("https://dropbox.com/s/k/a.tsv", "https://dropbox.com/s/k/a.tsv?dl=1"), ("https://x.org/a?dl=0", "https://x.org/a?dl=0")])
cases("c_input_kinds", "F13: addresses, accessions, neither.", names.input_kind, [("https://x.org/a.gz", "url"), (" GCST90000001 ", "accession"), ("ftp://h/a", "url"), ("some/file.tsv", None), ("", None)])
cases("c_safe_names", "F26: names that any file system takes.", names.safe_file_name, [("a/b.tsv", "a_b.tsv"), ("x:y?.gz", "x_y_.gz"), ("CON.txt", "_CON.txt"), ("...", "download"), ("", "download"), ("ok.tsv", "ok.tsv")])
cases("c_content_lengths", "S7: the whole size from headers.", lambda v: names.content_length(F.split_part(v, F.lit("|"), F.lit(1)), F.split_part(v, F.lit("|"), F.lit(2))), [("bytes 0-9/1234|10", 1234), ("bytes 0-9/*|10", 10), ("|77", 77), ("|", None)], out="bigint")
cases("c_range_support", "S7: servers that take ranges.", names.supports_ranges, [("bytes", True), (" BYTES ", True), ("none", False), ("", False), (None, False)], out="boolean")
cases("c_http_categories", "F25: categories of statuses.", names.status_category, [(403, "http_403"), (404, "http_404"), (410, "api_deprecated"), (408, "network_timeout"), (504, "network_timeout"), (416, "range_not_supported"), (500, "http_error"), (200, None)], given="bigint")
cases("c_directories", "S11: where an accession's files are.", lambda v: resolver.directory_url(F.lit("https://h/base//"), v), [("GCST000999", "https://h/base/GCST000001-GCST001000/GCST000999/"), ("GCST90038646", "https://h/base/GCST90038001-GCST90039000/GCST90038646/")])

# --- payloads ---------------------------------------------------------------

cases("c_textual", "B2: text or binary, by the first bytes as Latin-1.", payload.is_textual, [("plain\ttext\n", True), ("a\x00b", False), ("ÿþa\x00b\x00", True), ("þÿ\x00a", True), ("\x01\x02\x03", False), ("", True)], out="boolean")
cases("c_extension_hints", "B6: the compression that a name suggests.", payload.compression_by_extension, [("a.tsv.gz", "gzip"), ("a.tar.gz", "tar.gz"), ("a.bz2", "bzip2"), ("a.txt", None), ("b.zip", "zip"), ("c.xz", "xz")])
cases("c_format_labels", "B17: labels of formats.", lambda v: payload.format_label(F.split_part(v, F.lit("!"), F.lit(1)), F.split_part(v, F.lit("!"), F.lit(2))), [("\t!gzip", "TSV.GZIP"), (",!none", "CSV"), (" !bgzf", "SPACE.BGZF"), ("?!none", "UNKNOWN")])
cases("c_key_values", "H3: lines of keys and values.", header.is_key_value, [("build=37", True), ("trait: height", True), ("a b = c", False), ("x=\t1", False), ("plain", False), ("key=", False)], out="boolean")
cases("c_comments", "H2: comment lines.", header.is_comment, [("# a", True), ("  !b", True), (";; c", True), ("; c", False), ("// d", True), ("a # b", False)], out="boolean")
cases("c_header_confidence", "H8: how sure a winner is.", lambda v: header.confidence(v, v - 2), [(14.0, 0.85), (7.0, 0.5), (28.0, 0.85), (0.0, 0.15)], given="double", out="double")

# --- the catalogue ----------------------------------------------------------

cases("c_ssf_statuses", "F21: declared statuses.", catalog.ssf_status, [("GWAS-SSF v1.0", "GWAS-SSF"), (" pre-gwas-ssf", "pre-GWAS-SSF"), ("Non-GWAS-SSF", "Non-GWAS-SSF"), ("other", "other"), (None, None)])
cases("c_routes", "S21: answers of the withdrawn route.", catalog.route_status, [(410, "deprecated"), (404, "not_represented"), (503, "error"), (200, "available"), (301, "unknown")], given="bigint")
cases("c_fields_cover", "F19: declared fields that are enough for a score.", lambda v: catalog.fields_cover(F.split(v, ",")), [("chromosome,base_pair_location,effect_allele,other_allele,beta,p_value", True), ("rsid,effect_allele,other_allele,odds_ratio,p_value", True), ("chromosome,effect_allele,other_allele,beta,p_value", False), ("variant_id,effect_allele,other_allele,beta", False), ("", False)], out="boolean")
_V1 = '[{"type":"initial","numberOfIndividuals":100},{"type":"initial","numberOfIndividuals":50},{"type":"replication","numberOfIndividuals":7}]'
cases("c_discovery_n", "F20: individuals of the discovery stage.", lambda v: catalog.discovery_n(F.from_json(v, "array<struct<type:string,numberOfIndividuals:bigint>>")), [(_V1, 150), ("[]", None), ('[{"type":"initial"}]', None), ('[{"type":"replication","numberOfIndividuals":7}]', None)], out="bigint")
_ROUTES = [('{"_embedded":{"associations":[{"beta":1,"_links":2,"p_value":3}]}}', "beta|p_value"), ('{"data":[{"a":1}]}', "a"), ('{"x":1}', None), ('{"results":[{"z":1,"y":2}]}', "z|y")]


@query("SELECT p_partkey, " + nth_sql("p_partkey", [b for _, b in _ROUTES], "VARCHAR") + " AS fields FROM part")
def c_association_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the first record under any of the routes' keys."""
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), nth(F.col("p_partkey"), [a for a, _ in _ROUTES], "string").alias("body"))
    return catalog.association_fields(answers).select(F.col("source_id").alias("p_partkey"), F.array_join("fields", "|").alias("fields"))


@query("""SELECT c_custkey, 'GCST' || c_custkey AS accession, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS trait, CAST(2000 + c_custkey % 20 AS INTEGER) AS year, c_custkey % 2 = 0 AS has_sumstats,
    'European|' || c_nationkey AS ancestries FROM customer""")
def c_studies_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies from the newer route's JSON, one for each customer."""
    k = F.col("c_custkey")
    record = F.to_json(F.struct(
        F.concat(F.lit("GCST"), k).alias("accession_id"), F.when(k % 3 == 0, "NR").otherwise(F.col("c_mktsegment")).alias("disease_trait"), (k % 2 == 0).alias("full_summary_stats_available"),
        F.concat(2000 + k % 20, F.lit("-01-02")).alias("publication_date"), F.array(F.lit("European"), F.col("c_nationkey").cast("string")).alias("discovery_ancestry"),
    ))
    out = catalog.studies_v2(table(spark, sf_dir, "customer").select(record.alias("body")))
    return out.select(F.substring("accession", 5, 20).cast("long").alias("c_custkey"), "accession", "trait", "year", "has_sumstats", F.array_join("ancestries", "|").alias("ancestries"))


@query("SELECT c_custkey, CAST(c_custkey + 2 * c_nationkey AS BIGINT) AS n, NULLIF(CAST(c_nationkey AS BIGINT), 0) AS cases, c_custkey % 2 = 0 AS harmonised FROM customer")
def c_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars as YAML; numbers add up over the samples, 0 is unknown."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = F.format_string("gwas_id: GCST%d\nis_harmonised: %s\nsamples:\n  - sample_size: %d\n    case_count: 0\n  - sample_size: %d\n    case_count: %d\n", k, F.when(k % 2 == 0, "true").otherwise("false"), k, 2 * n, n)
    out = catalog.sidecars(table(spark, sf_dir, "customer").select(k.alias("source_id"), text.alias("text")))
    return out.select(F.col("source_id").alias("c_custkey"), F.col("sidecar_n").alias("n"), F.col("sidecar_cases").alias("cases"), F.col("is_harmonised").alias("harmonised"))


@query("""WITH p AS (SELECT p_partkey, p_brand, 'Brand' || right(p_brand, 1) AS label FROM part WHERE p_partkey % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY p_partkey) AS nth FROM p WHERE contains(lower(label), 'brand'))
    SELECT p_partkey, label FROM r WHERE nth = 1 ORDER BY p_partkey LIMIT 20""")
def c_search_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each matching label."""
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(k, k.alias("position"), F.when(k % 4 == 0, "gene").otherwise("trait").alias("resource"), F.concat(F.lit("Brand"), F.right("p_brand", F.lit(1))).alias("label"))
    return discovery.search_traits(entries, "bRaNd").select("p_partkey", "label")


@query("""SELECT p_partkey AS source_id, o AS ordinal, CASE o WHEN 1 THEN 'data-' || p_partkey || '.tsv.gz' ELSE 'harmonised/' END AS name, CAST(CASE o WHEN 1 THEN 1.5 * 1024 * 1024 END AS BIGINT) AS size FROM part, (VALUES (1), (2)) v(o)""")
def c_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of index pages; navigation goes."""
    row = lambda href, size: f'<tr><td><a href="{href}">x</a></td><td align="right">2024-01-01 10:00 </td><td align="right"> {size}</td></tr>'
    page = F.format_string("<table>" + row("/up/", "-") + row("data-%d.tsv.gz", "1.5M") + row("harmonised/", "-") + "</table>", "p_partkey")
    out = resolver.list_entries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), page.alias("html")))
    return out.select("source_id", F.col("ordinal").cast("int").alias("ordinal"), "name", "size")


@query("""SELECT p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN repeat('b', 32) WHEN p_partkey % 3 = 1 THEN repeat('a', 32) END AS md5 FROM part""")
def c_expected_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of files, one of the own directory before any other."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(k.alias("source_id"), F.concat(F.lit("f"), k % 3, F.lit(".tsv")).alias("name"), F.lit("here").alias("directory"))
    lines = [("there", "a" * 32 + "  f0.tsv\n" + "A" * 32 + " *sub/f1.tsv\nno sum"), ("here", "b" * 32 + "  f0.tsv\n")]
    sums = resolver.parse_checksums(spark.createDataFrame(lines, "directory string, text string"))
    return resolver.expected_md5(files, sums).select("source_id", "md5")


@query("""SELECT c_custkey AS accession, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 2 END AS pubmed, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS genome FROM customer""")
def c_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications and sidecars beside studies; what is not known stays NULL."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    studies, papers, cars = c.select(k.alias("accession")), c.filter(k % 2 == 0).select(k.alias("accession"), (k * 2).alias("pubmed")), c.filter(k % 3 == 0).select(k.alias("accession"), F.col("c_mktsegment").alias("genome"))
    return discovery.enrich(studies, papers, cars).select("accession", "pubmed", "genome")


@query("""SELECT p_partkey AS source_id, 'f' || p_partkey || '.tsv' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_partkey || '.tsv-meta.yaml' END AS sidecar FROM part""")
def c_with_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the sidecar that is named after them."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(k.alias("source_id"), F.concat(F.lit("f"), k, F.lit(".tsv")).alias("name"))
    entries = files.filter(F.col("source_id") % 2 == 0).select("source_id", F.concat("name", F.lit("-meta.yaml")).alias("name")).union(files)
    return resolver.with_sidecars(files, entries).select("source_id", "name", "sidecar")


_FILES = [("x.h.tsv.gz", True), ("x.f.tsv.gz", True), ("x.tsv", False), ("readme.txt", False)]
_SCORED = """WITH e AS (SELECT p_brand AS source_id, p_partkey AS ordinal, p_partkey % 4 AS k, p_size * 1000000 AS size FROM part),
    s AS (SELECT *, CASE k WHEN 0 THEN 6 + 5 + 3 WHEN 1 THEN 4 + 5 + 3 WHEN 2 THEN -1 + 2 END + least(1.5, log10(size) / 6) AS score FROM e WHERE k < 3),
    r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, ordinal))"""


@query(_SCORED + " SELECT source_id, CASE k WHEN 0 THEN 'x.h.tsv.gz' WHEN 1 THEN 'x.f.tsv.gz' ELSE 'x.tsv' END AS name, CAST(size AS BIGINT) AS size, round(score, 6) AS score, round(score - nxt, 6) AS gap FROM r WHERE nth = 1")
def c_best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file of each listing by name, folder and size, with its lead."""
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source_id"), k.alias("ordinal"), nth(k, [f for f, _ in _FILES], "string").alias("name"),
        (F.col("p_size") * 1000000).cast("long").alias("size"), nth(k, [h for _, h in _FILES], "boolean").alias("harmonised"), F.lit("GCST000001").alias("accession"),
    )
    return resolver.resolve_files(entries)


# --- populations and samples ------------------------------------------------

cases("c_populations", "F14: categories of terms and texts.", ancestry.normalised, [("European", "European"), ("caucasian", "European"), ("EAS", "East Asian"), ("South   Asian", "South Asian"), ("some african american people", "African American or Afro-Caribbean"), ("Sub-Saharan African", "Sub-Saharan African"), ("quartz mining", None), ("", None), ("Maori", "Oceanian"), ("unknown", "NR")])
_MATCHES = [("European", ["european"], 1.0), ("European", ["European", "East Asian"], 0.75), ("European", ["East Asian"], 0.0), ("European", [], 0.4), ("European", ["not reported"], 0.4), ("NR", ["NR"], 1.0), ("Martian", ["mostly martian people"], 0.6), ("Martian", ["European"], 0.0), ("European", ["gibberish"], 0.0), ("East Asian", ["Other admixed ancestry"], 0.0), ("European", ["European", "NR"], 1.0), ("", ["European"], 1.0)]
_ASKED, _GROUPS, _SCORES = zip(*((a, "|".join(g), s) for a, g, s in _MATCHES))


@query("SELECT c_custkey, " + nth_sql("c_custkey", list(_SCORES), "DOUBLE") + " AS score FROM customer WHERE " + nth_sql("c_custkey", list(_SCORES), "DOUBLE") + " > 0")
def c_population_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well studies fit a requested population; 0 goes."""
    k = F.col("c_custkey")
    groups = F.filter(F.split(nth(k, list(_GROUPS), "string"), r"\|"), lambda g: g != "")
    scored = table(spark, sf_dir, "customer").select(k, ancestry.match_score(nth(k, list(_ASKED), "string"), groups)["score"].alias("score"))
    return scored.filter("score > 0")


cases("c_population_filter", "P3: the score of each study for a population.", lambda v: ancestry.match_score(F.lit("eas"), F.split(v, r"\|"))["score"], [("Chinese", 1.0), ("Japanese|European", 0.75), ("European", 0.0), ("NR", 0.4)], out="double")
cases("c_population_summary", "F16: labels of groups.", lambda v: ancestry.summary(F.split(v, r"\|")), [("european|caucasian", "European"), ("European|EAS", "European, East Asian"), ("European|EAS|SAS", "European +2 more"), ("", "unknown"), ("Klingon", "Klingon")])
_DESCRIBED = [
    ("8,204 South Asian ancestry cases, 51,377 South Asian ancestry controls", "8204|51377|59581|0.855"), ("n=62,000", "||62000|0.85"), ("n=5000 typed on 700 variants", "|||"), ("n=5000 people, not more; then 900 variants", "||5000|0.85"),
    ("500 variants in cases", "|||"), ("310 Danish cases, 1,240 Dutch cases", "1550|||"), ("cases: 12; controls = 30", "12|30|42|0.855"), ("nothing", "|||"), ("1,500 twins", "||1500|0.85"),
]


@query("SELECT p_partkey, " + nth_sql("p_partkey", [b for _, b in _DESCRIBED], "VARCHAR") + " AS found FROM part")
def c_described_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cases, controls and totals of descriptions."""
    text = nth(F.col("p_partkey"), [a for a, _ in _DESCRIBED], "string")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = table(spark, sf_dir, "part").select("p_partkey", samples.count_from_text(text).alias("s")).select("p_partkey", "s.*")
    return found.select("p_partkey", F.concat_ws("|", said("cases"), said("controls"), said("total"), F.when(F.col("total").isNotNull(), said("total_confidence")).otherwise("")).alias("found"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'structured' WHEN c_custkey % 4 = 2 THEN 'sidecar' WHEN c_custkey % 4 = 3 THEN 'derived' ELSE 'text:initial_sample' END AS source,
    CASE WHEN c_custkey % 4 IN (1, 2) THEN c_custkey WHEN c_custkey % 4 = 3 THEN c_custkey + 10 ELSE 1200 END AS total, CASE WHEN c_custkey % 4 = 0 THEN 0.85 ELSE 1.0 END::DOUBLE AS confidence FROM customer""")
def c_resolved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured numbers first, then a sidecar, then texts, then the sum of both arms."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("long")
    studies = table(spark, sf_dir, "customer").select(
        k, F.when(k % 4 == 1, k).otherwise(0).alias("study_n"), none.alias("study_cases"), none.alias("study_controls"), F.when(k % 4 == 2, k).otherwise(0).alias("sidecar_n"),
        F.when(k % 4 == 3, k).otherwise(0).alias("sidecar_cases"), F.when(k % 4 == 3, 10).otherwise(0).alias("sidecar_controls"),
        F.when(k % 4 == 0, "1,200 individuals").alias("initial_sample"), F.lit(None).cast("string").alias("replication_sample"), F.lit("a title").alias("title"),
    )
    return samples.resolve_samples(studies).select("c_custkey", "total.source", F.col("total.value").alias("total"), "total.confidence")


# --- values -----------------------------------------------------------------

_DOMAINS = [
    ("chromosome", "chrX", True), ("chromosome", "26", False), ("chromosome", "07", True), ("position", "123", True), ("position", "-1", False), ("position", "1e5", False), ("variant_id", "rs12", True),
    ("variant_id", "1:123:A:G", True), ("variant_id", "x12", False), ("effect_allele", "acgt", True), ("effect_allele", "I", True), ("other_allele", "Q", False), ("beta", "-0.5", True), ("beta", "inf", False),
    ("odds_ratio", "0", False), ("hazard_ratio", "1.2", True), ("standard_error", "0", True), ("standard_error", "-1", False), ("p_value", "1.1", False), ("p_value", "0", True), ("effect_allele_frequency", "0.5", True),
    ("minor_allele_frequency", "0.5005", True), ("minor_allele_frequency", "0.6", False), ("info_score", "1.9", True), ("info_score", "2.1", False), ("cases", "0", True), ("sample_size", "0", False), ("n_studies", "3", True),
    ("neg_log10_p_value", "12", True), ("z_score", "abc", False), ("chromosome_position", "1:123", True), ("chromosome_position", "chrX_5_A_G", True), ("direction", "+-", None), ("controls", "-2", False), ("confidence_interval_lower", "0.2", True),
]


@query("SELECT p_partkey, " + nth_sql("p_partkey", [v for _, _, v in _DOMAINS], "BOOLEAN") + " AS valid FROM part")
def c_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against their concepts' domains."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", validation.is_valid(nth(k, [c for c, _, _ in _DOMAINS], "string"), nth(k, [x for _, x, _ in _DOMAINS], "string")).alias("valid"))


def _allele_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders' lines as tables with alleles and counts: mapped columns, and their rows."""
    concepts = ["effect_allele", "other_allele", "cases", "controls", "sample_size", "p_value", "chromosome"]
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("source_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("row_idx"),
        F.array(F.lit("A"), F.when(k % 3 == 0, "a").otherwise("G"), F.col("l_quantity").cast("string"), F.lit("10"), F.when(k % 2 == 0, F.col("l_quantity") + 10).otherwise(F.col("l_quantity") + 30).cast("string"),
                F.when(k == 1, "0").otherwise(F.col("l_discount").cast("string")), F.when(F.col("l_orderkey") % 200 < 100, "1:55").when(k == 1, "NA").otherwise("7")).alias("cells"),
    )
    mapped = rows.select("source_id").distinct().select("source_id", F.posexplode(F.array(*map(F.lit, concepts))).alias("ordinal", "concept")).withColumn("raw", F.col("concept"))
    return mapped, rows


@query("""SELECT l_orderkey % 200 AS source_id, count(*) AS allele_rows, CAST(count_if(l_linenumber % 3 = 0) AS BIGINT) AS equal_alleles, count(*) AS count_rows,
    CAST(count_if(l_linenumber % 2 <> 0 AND 20 / (l_quantity + 30) > 0.01) AS BIGINT) AS counts_off FROM lineitem GROUP BY 1""")
def c_cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal alleles, and cases and controls that do not add up."""
    return validation.cross_checks(*_allele_rows(spark, sf_dir))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, rows = _allele_rows(spark, sf_dir)
    asked = mapped.filter("concept IN ('p_value', 'chromosome')")  # each column is judged alone, so the others need not be
    return validation.validate(asked, rows.select("source_id", "row_idx", F.posexplode("cells").alias("ordinal", "cell")))


_VALIDATED = """WITH v AS (SELECT l_orderkey % 200 AS source_id, count(*) AS n, count_if(l_linenumber = 1) AS ones, count_if(l_linenumber = 1 OR l_discount = 0) AS zeros FROM lineitem GROUP BY 1),
    s AS (SELECT source_id, 'p_value' AS concept, n AS tested, n AS valid, 0 AS missing, CASE WHEN zeros > 0 THEN 'WARN' ELSE 'PASS' END AS status, CAST(NULL AS VARCHAR) AS suggested_concept FROM v
    UNION ALL SELECT source_id, 'chromosome', CASE WHEN source_id < 100 THEN n ELSE n - ones END, CASE WHEN source_id < 100 THEN 0 ELSE n - ones END, CASE WHEN source_id < 100 THEN 0 ELSE ones END,
    CASE WHEN source_id < 100 THEN 'FAIL' WHEN n > ones THEN 'PASS' ELSE 'NOT_TESTED' END, CASE WHEN source_id < 100 THEN 'chromosome_position' END FROM v)"""


@query(_VALIDATED + " SELECT source_id, concept, CAST(tested AS BIGINT) AS tested, CAST(valid AS BIGINT) AS valid, CAST(missing AS BIGINT) AS missing, status, suggested_concept FROM s")
def c_validated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, statuses, underflow, and what a column may be instead."""
    out = _validated(spark, sf_dir)
    return out.select("source_id", "concept", "tested", "valid", "missing", "status", "suggested_concept")


@query(_VALIDATED + """ SELECT source_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'NOT_TESTED' END AS status FROM s GROUP BY source_id""")
def c_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst tested status of each source."""
    return validation.overall_status(_validated(spark, sf_dir))


# --- mapping and readiness --------------------------------------------------

# raw name, normalised, concept, method, confidence
_SPELLED = [
    ("CHR", "chr", "chromosome", "alias", 0.95), ("chromosome", "chromosome", "chromosome", "canonical", 1.0), ("BP", "bp", "position", "alias", 0.95), ("base_pair_location", "base_pair_location", "position", "alias", 0.95),
    ("SNP", "snp", "variant_id", "alias", 0.95), ("variant-id", "variant_id", "variant_id", "canonical", 1.0), ("rsID", "rsid", "variant_id", "alias", 0.95), ("MarkerName", "markername", "variant_id", "alias", 0.95),
    ("ID", "id", "variant_id", "ambiguous", 0.75), ("Marker", "marker", "variant_id", "ambiguous", 0.75), ("A1", "a1", "effect_allele", "alias", 0.95), ("Effect Allele", "effect_allele", "effect_allele", "canonical", 1.0),
    ("A2", "a2", "other_allele", "alias", 0.95), ("ALT", "alt", "alternate_allele", "ambiguous", 0.75), ("REF", "ref", "reference_allele", "ambiguous", 0.75), ("BETA", "beta", "beta", "canonical", 1.0),
    ("Effect", "effect", "beta", "alias", 0.95), ("OR", "or", "odds_ratio", "alias", 0.95), ("odds.ratio", "odds_ratio", "odds_ratio", "canonical", 1.0), ("HR", "hr", "hazard_ratio", "alias", 0.95),
    ("Z", "z", "z_score", "alias", 0.95), ("SE", "se", "standard_error", "alias", 0.95), ("StdErr", "stderr", "standard_error", "alias", 0.95), ("P-value", "p_value", "p_value", "canonical", 1.0), ("P", "p", "p_value", "alias", 0.95),
    ("EAF", "eaf", "effect_allele_frequency", "alias", 0.95), ("MAF", "maf", "minor_allele_frequency", "alias", 0.95), ("AF", "af", "allele_frequency", "alias", 0.95), ("N", "n", "sample_size", "alias", 0.95),
    ("N_cases", "n_cases", "cases", "alias", 0.95), ("n controls", "n_controls", "controls", "alias", 0.95), ("INFO", "info", "info_score", "alias", 0.95), ("Direction", "direction", "direction", "canonical", 1.0),
    ("study_pval", "study_pval", "p_value", "heuristic", 0.72), ("joint_beta", "joint_beta", "beta", "heuristic", 0.68), ("x_odds_ratio_y", "x_odds_ratio_y", "odds_ratio", "heuristic", 0.78),
    ("sex_maf", "sex_maf", "minor_allele_frequency", "heuristic", 0.68), ("trait_eaf", "trait_eaf", "effect_allele_frequency", "heuristic", 0.7), ("lead_stderr", "lead_stderr", "standard_error", "heuristic", 0.7),
    ("color", "color", "unknown", "unknown", 0.0), ("dirion", "dirion", "unknown", "unknown", 0.0), ("chrom_hg18", "chrom_hg18", "unknown", "unknown", 0.0), ("r2_rsq", "r2_rsq", "unknown", "unknown", 0.0), ("neg_log10_p_value", "neg_log10_p_value", "neg_log10_p_value", "canonical", 1.0),
    ("chromosome_position_reference_allele_other_allele_b37", "chromosome_position_reference_allele_other_allele_b37", "variant_id", "alias", 0.95), ("hazard_ratio_adj", "hazard_ratio_adj", "hazard_ratio", "heuristic", 0.78), ("standard_error_gc", "standard_error_gc", "standard_error", "heuristic", 0.8),
    ("-log10_p_value", "log10_p_value", "neg_log10_p_value", "alias", 0.95), ("ＣＨＲ", "chr", "chromosome", "alias", 0.95),
]
#: Parts whose headers one task sorts, about, at most.
PARTS_A_TASK = 50_000
#: Columns of a part's header, and how a part and a place pick a name.
_WIDTH = 9
_STEP = "(p_partkey * 7 + (o % (5 + p_partkey % 5)) * (5 + p_partkey % 11))"
_HEADERS = f"""spelled(i, raw, n, concept, method, confidence) AS (VALUES {", ".join(f"({i}, {_sql(a)}, {_sql(b)}, {_sql(c)}, {_sql(d)}, {e}::DOUBLE)" for i, (a, b, c, d, e) in enumerate(_SPELLED))}),
    mapped AS (SELECT p_partkey AS source_id, o AS ordinal, raw, n, concept, method, confidence FROM part, generate_series(0, {_WIDTH - 1}) g(o) JOIN spelled ON i = {_STEP} % {len(_SPELLED)})"""


def _part_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for each part, of names that its key picks."""
    step = F.col("p_partkey") * 7 + (F.col("o") % (5 + F.col("p_partkey") % 5)) * (5 + F.col("p_partkey") % 11)  # most headers have a name twice
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", PARTS_A_TASK)  # a row becomes many, which are sorted in their task
    places = parts.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(_WIDTH - 1))).alias("o"))
    return places.select(F.col("p_partkey").alias("source_id"), F.col("o").alias("ordinal"), nth(step, [r for r, *_ in _SPELLED], "string").alias("raw"))


def _part_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_columns(_part_headers(spark, sf_dir))


@query(f"WITH {_HEADERS} SELECT source_id, CAST(ordinal AS INTEGER) AS ordinal, raw, n AS normalised, concept, method, confidence FROM mapped")
def c_mapped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all parts, mapped."""
    return _part_mapping(spark, sf_dir).select("source_id", "ordinal", "raw", "normalised", "concept", "method", "confidence")


@query(f"WITH {_HEADERS}, d AS (SELECT *, row_number() OVER (PARTITION BY source_id, n ORDER BY ordinal) AS nth FROM mapped) SELECT source_id, CAST(ordinal AS INTEGER) AS ordinal, n AS normalised FROM d WHERE nth = 2")
def c_doubled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur again."""
    return mapping.duplicate_names(_part_mapping(spark, sf_dir)).select("source_id", "ordinal", "normalised")


_FIRST = f"WITH {_HEADERS}, f AS (SELECT *, row_number() OVER (PARTITION BY source_id, concept ORDER BY confidence DESC, ordinal) AS nth, count(*) OVER (PARTITION BY source_id, concept) AS columns FROM mapped WHERE concept <> 'unknown')"


@query(_FIRST + " SELECT source_id, concept, raw, columns FROM f WHERE nth = 1")
def c_first_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the best column of each concept."""
    return mapping.first_for_concept(_part_mapping(spark, sf_dir)).select("source_id", "concept", "raw", "columns")


@query(f"WITH {_HEADERS} SELECT source_id, CAST(count_if(concept <> 'unknown') AS BIGINT) AS resolved, CAST(count_if(concept = 'unknown') AS BIGINT) AS unresolved FROM mapped GROUP BY source_id")
def c_resolved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: columns with and without a concept."""
    yes, no = mapping.split_resolved(_part_mapping(spark, sf_dir))
    both = yes.select("source_id", F.lit(1).alias("y")).union(no.select("source_id", F.lit(0).alias("y")))
    return both.groupBy("source_id").agg(F.count_if(F.col("y") == 1).alias("resolved"), F.count_if(F.col("y") == 0).alias("unresolved"))


@query(_FIRST + " SELECT source_id, raw, concept AS new_name FROM f WHERE columns = 1")
def c_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: new names, of concepts that one column alone claims."""
    return mapping.renames(_part_mapping(spark, sf_dir)).select("source_id", "raw", "new_name")


@query(_FIRST + " SELECT source_id, concept, raw FROM f WHERE columns = 1 AND confidence >= 0.9")
def c_keyword_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that other tools may be given."""
    return mapping.keyword_arguments(_part_mapping(spark, sf_dir)).select("source_id", "concept", "raw")


_CONFIDENCES = f"""{_FIRST}, b AS (SELECT source_id, concept, confidence AS c FROM f WHERE nth = 1),
    p AS (SELECT s.source_id, {", ".join(f"max(CASE WHEN concept = '{c}' THEN c END) AS {c}" for c in ("variant_id", "chromosome_position", "chromosome", "position", "effect_allele", "other_allele", "beta", "odds_ratio", "hazard_ratio", "z_score", "sample_size", "effect_allele_frequency", "minor_allele_frequency", "allele_frequency", "p_value", "neg_log10_p_value"))}
        FROM (SELECT DISTINCT p_partkey AS source_id FROM part) s LEFT JOIN b USING (source_id) GROUP BY s.source_id),
    q AS (SELECT source_id, greatest(variant_id, chromosome_position, CASE WHEN chromosome IS NOT NULL AND position IS NOT NULL THEN least(chromosome, position) END) AS v, effect_allele AS e, other_allele AS o,
        greatest(beta, odds_ratio, hazard_ratio, CASE WHEN z_score IS NOT NULL AND sample_size IS NOT NULL THEN least(z_score, sample_size, coalesce(effect_allele_frequency, minor_allele_frequency, allele_frequency)) + CASE WHEN coalesce(effect_allele_frequency, minor_allele_frequency, allele_frequency) IS NULL THEN NULL ELSE 0 END END) AS x,
        greatest(p_value, neg_log10_p_value) AS s FROM p),
    u AS (SELECT source_id, unnest(['variant_identification', 'effect_allele', 'other_allele', 'effect_size', 'significance']) AS requirement, coalesce(unnest([v, e, o, x, s]), 0.0) AS confidence FROM q)"""


@query(_CONFIDENCES + " SELECT source_id, requirement, confidence, CASE WHEN confidence >= 0.9 THEN 'satisfied' WHEN confidence >= 0.5 THEN 'uncertain' ELSE 'missing' END AS status FROM u")
def c_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's header offers for each requirement; a z-score takes its first companion that is there."""
    mapped = _part_mapping(spark, sf_dir)
    out = readiness.with_status(readiness.evaluate(mapped, mapped))
    return out.filter("required").select("source_id", "requirement", "confidence", "status")


@query(_CONFIDENCES + """, g AS (SELECT source_id, count_if(confidence < 0.5) AS m, count_if(confidence >= 0.5 AND confidence < 0.9) AS n FROM u GROUP BY source_id)
    SELECT source_id, CASE WHEN m = 0 AND n = 0 THEN 'READY' WHEN m <= 2 THEN 'PARTIAL' ELSE 'NOT_READY' END AS verdict FROM g""")
def c_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each part's header."""
    return readiness.assess(_part_mapping(spark, sf_dir)).select("source_id", "verdict")


@query("""SELECT p_partkey AS source_id, CASE p_partkey % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS confidence FROM part""")
def c_value_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of the columns that satisfy a requirement lowers its confidence."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"))
    results = parts.select("source_id", F.lit("variant_identification").alias("requirement"), F.lit(True).alias("required"), F.lit(1.0).alias("confidence"), F.array(F.lit("chr"), F.lit("pos")).alias("satisfied_by"))
    statuses = parts.select("source_id", F.posexplode(F.array(F.lit("PASS"), nth(F.col("source_id"), ["FAIL", "WARN", "NOT_TESTED", "PASS"], "string"))).alias("ordinal", "status"))
    validated = statuses.withColumn("raw", F.when(F.col("ordinal") == 0, "chr").otherwise("pos"))
    return readiness.with_value_evidence(results, validated).select("source_id", "confidence")


@query("SELECT p_partkey AS source_id, " + nth_sql("p_partkey", ["READY", "PARTIAL", "NOT_READY"], "VARCHAR") + " AS verdict FROM part")
def c_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from declared fields."""
    fields = ["variant_id,effect_allele,other_allele,beta,p_value", "variant_id,effect_allele,other_allele,beta", "beta"]
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", PARTS_A_TASK)
    declared = parts.select(F.col("p_partkey").alias("source_id"), F.split(nth(F.col("p_partkey"), fields, "string"), ",").alias("fields"))
    return readiness.assess_declared(declared).select("source_id", "verdict")


_CONCEPTS_OF = [
    (["odds_ratio"], ["log"]), (["odds_ratio", "beta"], []), (["hazard_ratio"], ["log"]), (["z_score"], ["z"]), (["z_score", "beta"], []), (["neg_log10_p_value"], ["p"]), (["minor_allele_frequency"], ["maf"]),
    (["minor_allele_frequency", "effect_allele_frequency"], []), (["chromosome_position"], ["split"]), (["chromosome_position", "chromosome", "position"], []), (["beta", "beta"], ["double", "several"]), (["cases", "cases"], ["double"]),
]


@query("SELECT p_partkey AS source_id, CAST(" + nth_sql("p_partkey", [len(w) for _, w in _CONCEPTS_OF], "BIGINT") + " AS BIGINT) AS warnings FROM part WHERE " + nth_sql("p_partkey", [len(w) for _, w in _CONCEPTS_OF], "BIGINT") + " > 0")
def c_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many warnings each part's concepts give."""
    listed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.posexplode(F.split(nth(F.col("p_partkey"), [",".join(c) for c, _ in _CONCEPTS_OF], "string"), ",")).alias("ordinal", "concept"))
    mapped = listed.withColumns({"raw": F.col("concept"), "normalised": F.col("concept"), "confidence": F.lit(1.0), "method": F.lit("canonical")})
    none = listed.limit(0).select("source_id", F.col("concept").alias("raw"), "concept", F.lit("PASS").alias("status"), F.lit(None).cast("string").alias("suggested_concept"))
    return readiness.warnings(mapped, none).groupBy("source_id").agg(F.count("*").alias("warnings"))


# --- search and scores ------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 END AS score, c_custkey % 2 = 0 AS has, CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE c_custkey % 1000 END AS n FROM customer)
    SELECT c_custkey, score::DOUBLE AS score, CAST(n AS BIGINT) AS n FROM s WHERE score > 0 ORDER BY score DESC, has DESC, n DESC, c_custkey LIMIT 25""")
def c_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best studies for a population."""
    k, g = F.col("c_custkey"), F.col("c_nationkey") % 3
    unknown = k % 5 == 0
    studies = table(spark, sf_dir, "customer").select(
        k.alias("position"), F.col("c_mktsegment").alias("trait"), (k % 2 == 0).alias("has_sumstats"), F.when(~unknown, k % 1000).alias("n_total"), F.lit(10).cast("long").alias("n_cases"), F.lit(20).cast("long").alias("n_controls"),
        F.when(g == 0, F.array(F.lit("British european"))).when(g == 1, F.array(F.lit("EUR"), F.lit("Han"))).otherwise(F.array(F.lit("Thai"))).alias("ancestries"),
    )
    return discovery.search(studies, "European").select(F.col("position").alias("c_custkey"), F.col("match.score").alias("score"), F.col("implied_n").alias("n"))


@query("""SELECT c_custkey FROM customer ORDER BY CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END DESC, (c_custkey % 3 = 0) DESC, c_custkey % 50 DESC, c_custkey % 7 DESC, c_custkey LIMIT 10""")
def c_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: assessed studies in order."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("position"), nth(k, ["READY", "PARTIAL", "NOT_READY", "UNKNOWN"], "string").alias("verdict"), (k % 3 == 0).alias("api_sufficient"), (k % 50).alias("n"), (k % 7).alias("year"))
    return discovery.rank_candidates(rows).select(F.col("position").alias("c_custkey"))


cases("c_availability", "R10: found, certainly absent, or unknown.", lambda v: discovery.availability(v == "found", v), [("found", True), ("http_404", False), ("file_not_found", False), ("network_timeout", None)], out="boolean")


@query("SELECT CAST(sum(least(n_chars, 1000)) AS BIGINT) AS bytes_read, CAST(sum(n_chars) AS BIGINT) AS bytes_whole, round(100 * (1 - sum(least(n_chars, 1000)) / sum(n_chars)), 4) AS avoided_percent FROM documents")
def c_transfer_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a run, and the share avoided."""
    return discovery.transfer_of_run(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size"), F.least("n_chars", F.lit(1000)).alias("bytes_read")))


@query("""SELECT round(count_if(p_partkey % 3 <> 0)::DOUBLE / count(*), 4) AS row_accuracy, round(count_if(p_partkey % 4 <> 0 AND p_partkey % 2 = 0)::DOUBLE / count_if(p_partkey % 2 = 0), 4) AS exact_header FROM part""")
def c_header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found header rows and whole headers against labels."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.lit(3).alias("true_row"), F.when(k % 3 == 0, 2).otherwise(3).alias("found_row"), F.when(k % 2 == 0, F.array(F.lit("A"), F.lit("b"))).alias("true_header"),
        F.when(k % 4 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit(" a"), F.lit("B"))).alias("found_header"),
    )
    return evaluate.header_scores(rows)


@query("SELECT unnest(['accessions that occur more than once', 'labels equal the predictions in every row']) AS message")
def c_manifest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a manifest."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("accession"), F.lit("a|b").alias("predicted_header"), F.lit("a|b").alias("true_header"))
    return evaluate.manifest_messages(rows)


@query("SELECT CAST(c_custkey AS VARCHAR) AS accession, 'label' AS true_verdict, CASE WHEN c_custkey % 2 = 0 THEN 'READY' END AS verdict FROM customer")
def c_fill_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions filled in beside labels that are never touched."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("accession"))
    results = rows.filter(F.col("accession").cast("long") % 2 == 0).select("accession", F.lit("READY").alias("verdict"), F.lit("no").alias("true_verdict"))
    return evaluate.fill_predictions(rows.select("accession", F.lit("label").alias("true_verdict"), F.lit("old").alias("verdict")), results).select("accession", "true_verdict", "verdict")


cases("c_manifest_headers", "F24: ordered headers of a manifest.", lambda v: F.array_join(manifest.header_cell(v), "+"), [("a\tb, c", "a+b, c"), ("a, b", "a+b"), ("a|b", "a+b"), ("a b", "a+b"), ("nan", None), ("", None)])
cases("c_manifest_mappings", "F24: mappings of a manifest.", lambda v: F.to_json(manifest.mapping_cell(v)), [("A1=effect_allele", '{"A1":"effect_allele"}'), ("x= |x=beta", '{"x":"beta"}'), ("y=", '{"y":"unknown"}'), ("", None)])
cases("c_manifest_verdicts", "F24: verdicts of a manifest.", manifest.verdict_cell, [("ready", "READY"), ("Not Ready", "NOT_READY"), ("yes", "READY"), ("0", "NOT_READY"), ("other", None), ("", None)])
cases("c_manifest_numbers", "F24: numbers of a manifest.", manifest.number_cell, [("1,234.5", 1234.5), ("x", None), ("", None), ("7", 7.0)], out="double")


# --- whole texts ------------------------------------------------------------

_DELIMITERS = ["\t", ",", ";", " ", "|"]
#: Every seventh part's text has one word a line, and so no header.
_WORDS_ALONE = 7


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table for each part, below a few comments, with a delimiter that its key picks."""
    k = F.col("p_partkey")
    d = nth(k, _DELIMITERS, "string")
    join = lambda *parts: F.call_function("concat_ws", d, *parts)
    row = lambda i: join(F.concat(F.lit("rs"), k + i), (k % 22 + 1).cast("string"), (k * 10 + i).cast("string"), F.lit("A"), F.lit("G"), F.lit("0.05"), F.lit("0.5"))
    head = join(*map(F.lit, ("SNP", "CHR", "BP", "A1", "A2", "BETA", "P")))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), row), "\n")
    text = F.concat(F.repeat(F.lit("# note\n"), (k % 3).cast("int")), head, F.lit("\n"), lines, F.lit("\n"))
    alone = F.concat(F.array_join(F.split("p_name", " "), "\n"), F.lit("\n"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")  # a part's text takes long to go through
    return parts.select(k.alias("source_id"), F.when(k % _WORDS_ALONE == 0, alone).otherwise(text).alias("text"))


_DELIMITER_SQL = "CASE p_partkey % 5 WHEN 0 THEN chr(9) WHEN 1 THEN ',' WHEN 2 THEN ';' WHEN 3 THEN ' ' ELSE '|' END"


@query(f"SELECT p_partkey AS source_id, CAST(p_partkey % 3 AS INTEGER) AS header_row, {_DELIMITER_SQL} AS delimiter, 'SNP/CHR/BP/A1/A2/BETA/P' AS header FROM part WHERE p_partkey % {_WORDS_ALONE} <> 0")
def c_detected_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, delimiter and place of every part's table."""
    return header.headers_of_texts(_part_texts(spark, sf_dir)).select("source_id", "header_row", "delimiter", F.array_join("header", "/").alias("header"))


@query(f"SELECT p_partkey AS source_id, 'header_not_found' AS category FROM part WHERE p_partkey % {_WORDS_ALONE} = 0")
def c_no_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: texts in which no line can be a header, as failure rows."""
    texts = _part_texts(spark, sf_dir)
    return header.header_failures(header.explode_lines(texts), header.headers_of_texts(texts))


@query(f"SELECT p_partkey AS source_id, CAST(i AS INTEGER) AS line_idx, '# note' AS line FROM part, generate_series(0, 1) g(i) WHERE i < p_partkey % 3 AND p_partkey % {_WORDS_ALONE} <> 0")
def c_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines above every header."""
    texts = _part_texts(spark, sf_dir)
    return header.preamble(header.explode_lines(texts), header.headers_of_texts(texts))


@query(f"""SELECT p_partkey AS source_id, CAST(i - 1 AS INTEGER) AS row_idx, 'rs' || (p_partkey + i) || '/' || (p_partkey % 22 + 1) || '/' || (p_partkey * 10 + i) || '/A/G/0.05/0.5' AS cells
    FROM part, generate_series(1, 12) g(i) WHERE p_partkey % {_WORDS_ALONE} <> 0""")
def c_sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows below every header."""
    rows = header.tables_of_texts(_part_texts(spark, sf_dir)).select("source_id", F.posexplode("rows").alias("row_idx", "cells"))
    return rows.select("source_id", "row_idx", F.array_join("cells", "/").alias("cells"))


@query(f"SELECT p_partkey AS source_id, true AS data_table FROM part WHERE p_partkey % {_WORDS_ALONE} <> 0")
def c_data_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was found is a table of data."""
    tables = keep(header.tables_of_texts(_part_texts(spark, sf_dir)), "headers")  # read three times below
    rows = tables.select("source_id", F.posexplode("rows").alias("row_idx", "cells"))
    return header.is_data_table(tables.drop("rows"), mapping.map_columns(mapping.explode_header(tables)), rows)


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' ORDER BY c_custkey % 1000 DESC, c_custkey LIMIT 25""")
def c_search_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best studies of those with summary statistics, without a trait."""
    k = F.col("c_custkey")
    studies = table(spark, sf_dir, "customer").select(
        k.alias("position"), F.col("c_mktsegment").alias("trait"), F.when(k % 2 == 0, True).when(k % 3 == 0, False).alias("has_sumstats"),
        (k % 1000).alias("n_total"), F.lit(None).cast("long").alias("n_cases"), F.lit(None).cast("long").alias("n_controls"), F.array().cast("array<string>").alias("ancestries"),
    )
    return discovery.search(studies, excludes=["build"], sumstats_only=True).select(F.col("position").alias("c_custkey"))


@query(f"""WITH c AS (SELECT c_custkey, (c_custkey % 4) + 1 AS n, c_custkey % 10 AS a FROM customer)
    SELECT c_custkey AS source_id, string_agg(line, '; ' ORDER BY line) AS findings FROM (
        SELECT c_custkey, 'both alleles are the same in ' || n || ' of 5 rows' AS line FROM c UNION ALL
        SELECT c_custkey, CASE WHEN a < 5 THEN 'cases and controls add up to the sample size in all 5 rows' ELSE 'cases and controls miss the sample size by over 1% in 5 of 5 rows' END FROM c) GROUP BY c_custkey""")
def c_cross_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of every customer's rows say of each other."""
    k = F.col("c_custkey")
    concepts = ["other_allele", "effect_allele", "cases", "controls", "sample_size"]
    customers = table(spark, sf_dir, "customer").select(k.alias("source_id"))
    i = F.col("row_idx")
    total = F.when(F.col("source_id") % 10 < 5, 300).otherwise(200)
    rows = customers.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row_idx")).select("source_id", "row_idx", F.array(F.lit("a "), F.when(i <= F.col("source_id") % 4, "A").otherwise("G"), F.lit("100"), F.lit("200"), total.cast("string")).alias("cells"))
    mapped = customers.select("source_id", F.posexplode(F.array(*map(F.lit, concepts))).alias("ordinal", "concept")).withColumn("raw", F.col("concept"))
    told = readiness.cross_findings(validation.cross_checks(mapped, rows))
    return told.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("warning")), "; ").alias("findings"))
