"""``python -m statsift COMMAND TARGET ...``: search, probe, assess, scan, download, extract, run, benchmark.

Settings come from defaults, ``--config``, the environment (``STATSIFT_...``) and the options, the later over the earlier."""

from __future__ import annotations

import argparse
import codecs
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift import session
from statsift.functions import manifest
from statsift.operators import discovery, evaluate, extract, header, mapping
from statsift.plans import accessions, batches, searching, triage
from statsift.settings import Settings, load
from statsift.sources import download, kept, sinks

FORMATS = ("table", "csv", "json", "html")


def emit(result: DataFrame, command: str, how: str, output: str | None, **settings) -> None:
    """A result on the terminal or in a file."""
    if how == "table" or not output:
        sinks.render_console(result)
    elif how == "csv":
        sinks.write_csv(result, output)
    elif how == "json":
        sinks.write_json(result, output, command, sinks.provenance(**settings))
    else:
        with open(output, "w", encoding="utf-8") as f:
            f.write(sinks.render_page(command, (command, result)))


def transfer(s: Settings) -> dict:
    """The options of ``bounded_prefix`` that the settings hold."""
    return {"transport": s.transport, "requestsPerSecond": s.requests_per_second, "retries": s.retries}


def extract_table(spark: SparkSession, a: argparse.Namespace, s: Settings) -> None:
    source, out = a.targets
    if not a.overwrite and os.path.exists(out):
        raise SystemExit(f"exists: {out}")
    decoded = triage.decode_prefixes(triage.probe(spark, [source], s.probe_bytes, **transfer(s)))
    how = decoded.select("compression", "encoding").first()
    if how and not extract.can_read(source, how["compression"]):
        if (named := spark.conf.get("spark.checkpoint.dir", None)) is None and not spark.sparkContext.master.startswith("local["):
            raise SystemExit("spark.checkpoint.dir names no folder that all executors share")
        with tempfile.TemporaryDirectory(dir=named and named.removeprefix("file://")) as folder:
            got = extract.unpack(decoded.select("source_id", "compression"), folder).first()
            if got["category"]:
                raise SystemExit(got["category"])
            read_and_write(spark, a, got["path"], decoded, how)
    else:
        read_and_write(spark, a, source, decoded, how)


def read_and_write(spark: SparkSession, a: argparse.Namespace, source: str, decoded: DataFrame, how) -> None:
    if how and how["encoding"].startswith(("utf-16", "utf-32")):
        raise SystemExit(f"unsupported_encoding: {how['encoding']}")
    # the prefix alone may be ASCII
    encoding = "UTF-8" if not how or how["encoding"] in ("ascii", "utf-8", "utf-8-sig") else codecs.lookup(how["encoding"]).name
    found = header.headers_of_texts(decoded.select("source_id", "text"))
    r = found.first()
    if r is None:
        raise SystemExit("header_not_found")
    table = extract.read_table(spark, source, r["delimiter"], r["header_row"], r["header"], encoding)
    names = dict(zip(table.columns, r["header"]))
    if a.rename or a.rename_symbols:
        mapped = mapping.map_columns(mapping.explode_header(found))
        names |= {table.columns[x["ordinal"]]: x["new_name"] for x in mapping.renames(mapped, a.rename_symbols).collect()}
    kept = table.filter(~F.coalesce(F.startswith(table.columns[0], F.lit("#")), F.lit(False)))
    cleaned, report = extract.clean(kept, names, a.max_rows)
    sinks.write_csv(cleaned, a.targets[1], delimiter={"tab": "\t", "comma": ",", "semicolon": ";"}[a.delimiter])
    emit(report, "extract", "json" if a.report else "table", a.report)


def texts_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The searches named: one of all targets."""
    return spark.createDataFrame([("search", " ".join(a.targets))], "source_id string, text string")


def search(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    """Studies from a Parquet table, or from the catalogue; ``--check-files`` asks which files are there."""
    if a.studies:
        return discovery.search(spark.read.parquet(a.studies), a.population, s.limit, a.exclude, a.sumstats_only)
    found, left_out = searching.search(texts_of(spark, a), s, a.population, s.limit, a.exclude, a.sumstats_only)
    for r in left_out.filter("excluded > 0").collect():  # one row a search
        print(f"left out by trait: {r['excluded']} of {r['of']}")
    if a.check_files:
        found = found.join(accessions.check_files(found, s), "accession", "left")
    return found.orderBy("rank")


def run(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    """Search, assess, rank; a Parquet table of studies may name each file by ``url``, else they go by accession."""
    if not a.studies:
        return searching.run(texts_of(spark, a), s, a.population, s.limit, a.exclude).orderBy("place")
    found = kept.keep(discovery.search(spark.read.parquet(a.studies), a.population, s.limit, a.exclude, True), "found")
    if "url" in found.columns:
        target = F.coalesce("url", "accession")
    else:
        target = F.col("accession")
    named = found.withColumn("target", target)
    verdicts = accessions.assess_targets(named.select("target"), s).select("target", "verdict", "route", "category", "missing", "uncertain", "declared_by")
    ranked = named.join(verdicts, "target", "left").withColumns({"api_sufficient": F.col("declared_by").isNotNull(), "n": F.col("implied_n")})
    return discovery.rank_candidates(ranked, s.limit)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="statsift")
    parser.add_argument("command", choices=("search", "probe", "assess", "scan", "download", "extract", "run", "benchmark"))
    parser.add_argument("targets", nargs="*")
    parser.add_argument("--config")
    parser.add_argument("--probe-bytes", type=int)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--format", choices=FORMATS)
    parser.add_argument("--output")
    parser.add_argument("--studies", help="a Parquet table of studies, instead of the catalogue")
    parser.add_argument("--population")
    parser.add_argument("--exclude", action="append")
    parser.add_argument("--sumstats-only", action="store_true")
    parser.add_argument("--check-files", action="store_true")
    parser.add_argument("--harmonised", choices=("auto", "yes", "no"))
    parser.add_argument("--force-probe", action="store_true")
    parser.add_argument("--no-api", action="store_true")
    parser.add_argument("--run", help="benchmark: a folder for the predictions, which an interrupted run goes on from")
    parser.add_argument("--max-rows", type=int)
    parser.add_argument("--delimiter", choices=("tab", "comma", "semicolon"), default="tab")
    parser.add_argument("--rename", action="store_true")
    parser.add_argument("--rename-symbols", action="store_true")
    parser.add_argument("--emit-code", action="store_true")
    parser.add_argument("--overwrite", action="store_true", default=None)
    parser.add_argument("--md5")
    parser.add_argument("--report")
    parser.add_argument("--by", action="append", default=[])
    a = parser.parse_args(arguments)
    s = load(a.config, probe_bytes=a.probe_bytes, limit=a.limit, output_format=a.format, overwrite=a.overwrite)
    a.overwrite = s.overwrite
    spark = session.build()
    if a.command == "extract":
        extract_table(spark, a, s)
        return
    if a.command == "probe":
        result = triage.probe(spark, a.targets, s.probe_bytes, **transfer(s)).drop("content")
    elif a.command == "scan":
        result = triage.scan(spark, a.targets, s.probe_bytes, **transfer(s))
        if a.emit_code:
            named = result.filter("header IS NOT NULL").select("source_id", "header")
            result = mapping.rename_code(mapping.map_columns(mapping.explode_header(named)))
    elif a.command == "assess":
        targets = spark.createDataFrame([(t,) for t in a.targets], "target string")
        result = accessions.assess_targets(targets, s, prefer=a.harmonised, force_probe=a.force_probe, skip_structured=a.no_api)
    elif a.command == "download":
        *urls, folder = a.targets
        wanted = spark.createDataFrame([(u, u.split("?")[0].rstrip("/").rsplit("/", 1)[-1], a.md5) for u in urls], "source_id string, name string, md5 string")
        result = download.download(wanted, folder, s.overwrite)
    elif a.command == "search":
        result = search(spark, a, s)
    elif a.command == "run":
        result = run(spark, a, s)
    else:
        rows = manifest.read_manifest(spark, a.targets[0])
        if a.run:
            rows = batches.predicted(rows, s, a.run)
        sinks.render_console(evaluate.manifest_messages(rows))
        result = triage.benchmark(rows, a.by)
    emit(result, a.command, s.output_format, a.output, probe_bytes=s.probe_bytes)


if __name__ == "__main__":
    main()
