"""From a directory listing to the file that should be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.names import accession_block, file_kind, parse_size_label

_ROW = r'(?is)<a href="([^"?][^"]*)">[^<]+</a>\s*</td>\s*<td[^>]*>([^<]*)</td>\s*<td[^>]*>([^<]*)</td>'
_LINK = r'(?i)<a href="([^"?][^"]*)">[^<]+</a>'


def directory_url(base: Column, accession: Column, hint: Column | None = None) -> Column:
    """Where an accession's files are: where its study says, over https, else by its block."""
    if hint is not None:
        told = F.regexp_replace(F.regexp_replace(hint, "^ftp://", "https://"), "^http://ftp[.]ebi[.]ac[.]uk", "https://ftp.ebi.ac.uk")
        return F.coalesce(F.concat(F.regexp_replace(told, "/+$", ""), F.lit("/")), directory_url(base, accession))
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), accession_block(accession), F.lit("/"), accession, F.lit("/"))


def list_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """``source_id, ordinal, name, last_modified, size`` of an index page's entries.

    A page without a table falls back to its links; navigation goes."""
    get = lambda pattern, group: F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(get(_ROW, 1).alias("name"), get(_ROW, 2).alias("last_modified"), get(_ROW, 3).alias("label"))
    links = F.transform(get(_LINK, 1), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("label")))
    entries = pages.select("source_id", F.posexplode(F.when(F.size(get(_ROW, 1)) > 0, rows).otherwise(links)).alias("ordinal", "entry")).select("source_id", "ordinal", "entry.*")
    kept = entries.filter(~F.col("name").rlike(r"^(/|\.\.?/?$|#|javascript:|mailto:)"))
    return kept.select("source_id", "ordinal", "name", F.trim("last_modified").alias("last_modified"), parse_size_label(F.trim("label")).alias("size"))


def file_score(name: Column, size: Column, harmonised: Column, prefer: Column, accession: Column) -> Column:
    """How well a file fits, by its name, folder and size."""
    low = F.lower(name)
    ends = lambda *xs: low.rlike("(" + "|".join(x.replace(".", r"\.") for x in xs) + ")$")
    form = F.when(F.contains(low, F.lit(".h.tsv")), 6.0).when(F.contains(low, F.lit(".f.tsv")), 4.0).otherwise(0.0)
    place = F.when(harmonised, F.when(prefer, 5.0).otherwise(-5.0)).otherwise(F.when(prefer, -1.0).otherwise(2.0))
    suffix = (
        F.when(ends(".tsv.gz", ".txt.gz", ".csv.gz", ".tsv.bgz"), 3.0).when(ends(".tsv", ".txt", ".csv", ".tab"), 2.0)
        .when(ends(".gz"), 1.5).when(ends(".zip", ".tar"), 0.5).otherwise(0.0)
    )
    named = F.when(F.contains(low, F.lower(accession)), 1.0).otherwise(0.0)
    large = F.when(size == 0, -10.0).when(size > 0, F.least(F.lit(1.5), F.log10(F.greatest(size, F.lit(1)).cast("double")) / 6)).otherwise(0.0)
    return F.when(file_kind(name) != "data", -100.0).otherwise(form + place + suffix + named + large)


def resolve_files(entries: DataFrame, prefer: str = "auto", keep: tuple[str, ...] = ()) -> DataFrame:
    """The best data file of each source, its score and its lead; ``keep``: columns of its entry that go along.

    ``entries``: ``source_id, ordinal, name, size, harmonised, accession``.
    ``prefer``: ``yes`` keeps harmonised files alone, ``no`` the others, ``auto`` both."""
    if prefer != "auto":
        entries = entries.filter(F.col("harmonised") if prefer == "yes" else ~F.col("harmonised"))
    scored = entries.withColumn("score", file_score(F.col("name"), F.col("size"), F.col("harmonised"), F.lit(prefer != "no"), F.col("accession")))
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "ordinal")
    ranked = scored.filter("score > -100").withColumns({"rank": F.row_number().over(order), "runner_up": F.lead("score").over(order)})
    return ranked.filter("rank = 1").select("source_id", "name", "size", F.round("score", 6).alias("score"), F.round(F.col("score") - F.col("runner_up"), 6).alias("gap"), *keep)


def nothing_left(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sources of which no data file is left, as failure rows."""
    return entries.select("source_id").distinct().join(resolved, "source_id", "left_anti").select("source_id", F.lit("no_matching_file").alias("category"))


def with_sidecars(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Each file with its sidecar, which is named after it."""
    wanted = files.withColumn("_wanted", F.concat("name", F.lit("-meta.yaml")))
    there = entries.select("source_id", F.col("name").alias("_wanted"), F.col("name").alias("sidecar"))
    return wanted.join(there, ["source_id", "_wanted"], "left").drop("_wanted")


def expected_md5(files: DataFrame, sums: DataFrame) -> DataFrame:
    """The checksum of each file's name, one from its own directory before any other."""
    joined = files.join(sums.select("directory", F.col("name").alias("sum_name"), "md5").withColumnRenamed("directory", "sum_directory"), F.col("name") == F.col("sum_name"), "left")
    own = F.row_number().over(Window.partitionBy("source_id", "name").orderBy(F.desc(F.col("directory") == F.col("sum_directory")), "md5"))
    return joined.withColumn("nth", own).filter("nth = 1").drop("nth", "sum_name", "sum_directory")


def parse_checksums(texts: DataFrame) -> DataFrame:
    """``directory, name, md5`` from the lines of checksum files."""
    lines = texts.select("directory", F.explode(F.split("text", r"\r?\n")).alias("line"))
    pattern = r"^\s*([0-9a-fA-F]{32})\s+\*?(.+?)\s*$"
    return lines.filter(F.col("line").rlike(pattern)).select("directory", F.regexp_extract(F.regexp_extract("line", pattern, 2), r"([^/]+)$", 1).alias("name"), F.lower(F.regexp_extract("line", pattern, 1)).alias("md5"))
