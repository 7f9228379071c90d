"""The accession and search routes over stored answers and a transport, against plain loops."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from statsift import __main__ as command
from statsift import settings
from statsift.plans import accessions, batches, searching
from statsift.sources import catalogue
from statsift.sources.catalogue import Routes
from statsift.sources.prefix import probe_table, read_prefixes

HOST = "http://h"
PLACES = {"api_v2": HOST + "/v2", "api_v1": HOST + "/v1", "files": HOST + "/f", "associations": HOST + "/as", "text_index": HOST + "/text"}
GOOD = "SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n" + "".join(f"rs{i}\t1\t{i}\tA\tG\t0.1\t0.01\t0.5\n" for i in range(1, 40))
POOR = "SNP\tnotes\n" + "".join(f"rs{i}\tx\n" for i in range(1, 40))
SSF = "file_type: GWAS-SSF v1.0\ndata_file_md5sum: AB\nsamples:\n  - sample_size: 12\n"


def index(*rows):
    return "<table>" + "".join(f'<tr><td><a href="{n}">{n}</a></td><td>2024-01-01 10:00 </td><td> {s}</td></tr>' for n, s in rows) + "</table>"


def folder(accession):
    low = (int(accession[4:]) - 1) // 1000 * 1000 + 1
    return f"{HOST}/f/GCST{low:06d}-GCST{low + 999:06d}/{accession}/"


def study(accession, **more):
    return json.dumps({"accession_id": accession, "full_summary_stats_available": True, "initial_sample_size": "1,000 cases, 2,000 controls", **more})


def answers():
    """Every branch of the accession route: url, status (None: no network), body."""
    out = []
    v2 = lambda a, **more: out.append((f"{HOST}/v2/studies/{a}", 200, study(a, **more)))
    put = lambda *row: out.append(row)
    v2("GCST000001")
    put(folder("GCST000001"), 200, index(("a.tsv", "1.5M"), ("harmonised/", "-"), ("md5sum.txt", "1K")))
    put(folder("GCST000001") + "harmonised/", 200, index(("b.h.tsv", "2M"), ("b.h.tsv-meta.yaml", "1K")))
    put(folder("GCST000001") + "harmonised/b.h.tsv-meta.yaml", 200, SSF)
    put(folder("GCST000001") + "harmonised/b.h.tsv", 200, POOR)
    put(folder("GCST000001") + "a.tsv", 200, GOOD)
    put(folder("GCST000001") + "md5sum.txt", 200, "c" * 32 + "  a.tsv\n")
    v2("GCST000002")
    put(folder("GCST000002"), 200, index(("a.tsv", "1.5M"), ("md5sum.txt", "1K")))
    put(folder("GCST000002") + "a.tsv", 200, GOOD)
    put(folder("GCST000002") + "md5sum.txt", 200, "D" * 32 + "  a.tsv\n" + "e" * 32 + "  other.tsv\n")
    v2("GCST000003", full_summary_stats_available=False)
    v2("GCST000004")  # no folder
    v2("GCST000005")
    put(folder("GCST000005"), 200, index(("readme.txt", "1K")))  # nothing to read
    v2("GCST000006")
    put(folder("GCST000006"), None, None)  # no network
    v2("GCST000007")
    put(folder("GCST000007"), 200, index(("a.tsv", "1.5M"),))
    put(folder("GCST000007") + "a.tsv", 503, "")
    v2("GCST000008")
    put(folder("GCST000008"), 200, index(("a.tsv", "1.5M"),))
    put(folder("GCST000008") + "a.tsv", 200, "<!DOCTYPE html><html><body>gone</body></html>")
    v2("GCST000009", full_summary_stats="ftp://elsewhere/x")
    put("https://elsewhere/x/", 200, index(("z.tsv", "3M"), ("harmonised/", "-")))
    put("https://elsewhere/x/harmonised/", 500, "")  # passed over
    put("https://elsewhere/x/z.tsv", 200, POOR)
    put(f"{HOST}/as/studies/GCST000009/associations?size=5", 410, "")
    v2("GCST000010")
    put(folder("GCST000010"), 200, index(("a.tsv", "1.5M"), ("a.tsv-meta.yaml", "1K")))
    put(folder("GCST000010") + "a.tsv-meta.yaml", 200, "file_type: pre-GWAS-SSF\n")
    record = {"variant_id": 1, "effect_allele": 1, "other_allele": 1, "beta": 1, "p_value": 1, "_links": 1}
    put(f"{HOST}/as/studies/GCST000010/associations?size=5", 200, json.dumps({"_embedded": {"associations": [record]}}))
    put(folder("GCST000010") + "a.tsv", 200, POOR)
    put(f"{HOST}/v2/studies/GCST000011", 500, "")
    put(f"{HOST}/v1/studies/GCST000011", 200, json.dumps({"accessionId": "GCST000011", "fullPvalueSet": True, "ancestries": [{"type": "initial", "numberOfIndividuals": 70}, {"type": "replication", "numberOfIndividuals": 9}]}))
    put(folder("GCST000011"), 200, index(("a.tsv", "1.5M"), ("a.tsv-meta.yaml", "1K")))
    put(folder("GCST000011") + "a.tsv", 200, GOOD)  # its sidecar is listed, but not served
    put(f"{HOST}/v2/studies/GCST000012", None, None)
    put(f"{HOST}/v1/studies/GCST000012", None, None)
    return out


@pytest.fixture(scope="module")
def stored(spark):
    return Routes(settings.load(env={}, **PLACES), spark.createDataFrame(answers(), "url string, status int, body string").coalesce(1))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(f" gcst{i:06d}",) for i in range(1, 14)] + [("GCST000001",), ("x",), ("",), (None,)], "accession string")


EXPECTED = {
    "GCST000001": ("metadata", "READY", None, "sidecar"), "GCST000002": ("probe", "READY", None, None), "GCST000003": (None, "UNKNOWN", "not_represented", None),
    "GCST000004": (None, "UNKNOWN", "file_not_found", None), "GCST000005": (None, "UNKNOWN", "file_not_found", None), "GCST000006": (None, "UNKNOWN", "network_error", None),
    "GCST000007": (None, "UNKNOWN", "http_error", None), "GCST000008": (None, "UNKNOWN", "non_data_response", None), "GCST000009": ("probe", "NOT_READY", None, None),
    "GCST000010": ("metadata", "READY", None, "associations"), "GCST000011": ("probe", "READY", None, None), "GCST000012": (None, "UNKNOWN", "api_error", None),
    "GCST000013": (None, "UNKNOWN", "invalid_accession", None), "X": (None, "UNKNOWN", "invalid_accession", None), "": (None, "UNKNOWN", "invalid_accession", None),
}


def test_every_branch_of_the_accession_route(stored, asked):
    rows = {r["accession"]: r for r in accessions.assess(asked, stored).collect()}
    assert {a: (r["route"], r["verdict"], r["category"], r["declared_by"]) for a, r in rows.items()} == EXPECTED
    one, two, nine, eleven = (rows[f"GCST0000{i}"] for i in ("01", "02", "09", "11"))
    assert (one["name"], one["size"], one["md5"], one["total"], one["cases"]) == ("b.h.tsv", 2 << 20, "ab", 12, 1000)
    assert (two["md5"], two["total"], two["header"][:2], two["bytes_received"]) == ("d" * 32, 3000, ["SNP", "CHR"], len(GOOD))
    assert (nine["legacy"], nine["url"]) == ("deprecated", "https://elsewhere/x/z.tsv") and "effect_allele" in nine["missing"]
    assert (eleven["total"], eleven["legacy"]) == (70, "not_represented")


def test_forced_and_skipped_routes(stored, asked):
    some = asked.filter("accession IN ('GCST000001', ' gcst000010', ' gcst000002')")
    forced = {r["accession"]: r for r in accessions.assess(some, stored, force_probe=True).collect()}
    assert (forced["GCST000001"]["route"], forced["GCST000001"]["verdict"], forced["GCST000001"]["note"]) == ("probe", "NOT_READY", "declared READY, read NOT_READY")
    raw = {r["accession"]: r for r in accessions.assess(some, stored, prefer="no", skip_structured=True).collect()}
    assert (raw["GCST000001"]["name"], raw["GCST000001"]["md5"], raw["GCST000001"]["verdict"]) == ("a.tsv", "c" * 32, "READY")
    assert raw["GCST000010"]["verdict"] == "NOT_READY" and raw["GCST000010"]["declared_by"] is None
    only = {r["accession"]: r["category"] for r in accessions.assess(some, stored, prefer="yes").collect()}
    assert only == {"GCST000001": None, "GCST000002": "file_not_found", "GCST000010": "file_not_found"}


def test_no_accessions(spark, stored):
    assert accessions.assess(spark.createDataFrame([], "accession string"), stored).collect() == []


def test_check_files(spark, stored, asked):
    studies = catalogue.studies_by_accession(asked.filter("accession LIKE ' gcst%'"), stored)
    more = spark.createDataFrame([(f"GCST{i:06d}", True, None) for i in range(2000, 3000)], "accession string, has_sumstats boolean, location string")
    got = {r["accession"]: tuple(r)[1:5] + (r["category"],) for r in accessions.check_files(studies.select("accession", "has_sumstats", "location").union(more), stored).collect()}
    assert len(got) == 1013 and all(got[f"GCST{i:06d}"] == (False, False, False, None, "file_not_found") for i in range(2000, 3000))
    assert got["GCST000001"] == (True, True, True, "GWAS-SSF", None)
    assert got["GCST000002"] == (True, False, False, None, None)
    assert got["GCST000003"] == (False, False, False, None, "not_represented")
    assert got["GCST000006"] == (None, None, None, None, "network_error")
    assert got["GCST000010"] == (True, True, False, "pre-GWAS-SSF", None)
    assert got["GCST000011"] == (True, None, False, None, "metadata_missing")


def test_targets_of_all_kinds(spark, stored, tmp_path):
    (tmp_path / "t.tsv").write_text(GOOD)
    live = Routes(stored.settings, stored.stored.union(spark.createDataFrame([(str(tmp_path / "t.tsv"), 200, GOOD), (HOST + "/u.tsv", 200, POOR)], stored.stored.schema)))
    targets = spark.createDataFrame([("gcst000002",), (HOST + "/u.tsv",), (str(tmp_path / "t.tsv"),), ("ftp://unknown.host/x.tsv",), (HOST + "/none.tsv",)], "target string")
    got = {r["target"]: (r["route"], r["verdict"], r["category"]) for r in accessions.assess_targets(targets, live).collect()}
    assert got == {"GCST000002": ("probe", "READY", None), HOST + "/u.tsv": ("probe", "NOT_READY", None), str(tmp_path / "t.tsv"): ("probe", "READY", None), "ftp://unknown.host/x.tsv": (None, "UNKNOWN", "unsupported_scheme"), HOST + "/none.tsv": (None, "UNKNOWN", "http_404")}


def test_a_stopped_benchmark_goes_on(spark, stored, tmp_path):
    rows = spark.createDataFrame([(a, "READY") for a in EXPECTED if a.startswith("GCST")] + [("gcst000002", "PARTIAL")], "accession string, true_verdict string")
    whole = batches.predict(rows, stored, str(tmp_path / "whole"), batch=20)
    batches.predict(rows, stored, str(tmp_path / "parts"), batch=7, stop_after=1)
    (tmp_path / "parts/predictions/part=1").mkdir(exist_ok=True)  # a batch that was begun
    there = sorted(p.stat().st_mtime_ns for p in (tmp_path / "parts/predictions/part=0").glob("*.parquet"))
    again = batches.predict(rows, stored, str(tmp_path / "parts"), batch=7)
    assert sorted(p.stat().st_mtime_ns for p in (tmp_path / "parts/predictions/part=0").glob("*.parquet")) == there
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr) and whole.count() == 13
    filled = batches.predicted(rows, stored, str(tmp_path / "parts"))
    assert {(r["accession"], r["true_verdict"], r["predicted_verdict"]) for r in filled.collect()} == {(a, "READY", v[1]) for a, v in EXPECTED.items() if a.startswith("GCST")} | {("gcst000002", "PARTIAL", "READY")}


# --- search -----------------------------------------------------------------


class Catalogue:
    """A catalogue of labels with their studies; counts what it is asked."""

    def __init__(self, labels: dict, text: dict, broken=(), silent=()):
        self.labels, self.text, self.broken, self.silent = labels, text, broken, silent

    def studies(self, label, old, sumstats_only):
        out = [(a, a % 3 == 0) for a in self.labels[label]]
        return [x for x in out if x[1] or not sumstats_only or old]

    def answers(self, limit, sumstats_only):
        """Every page that could be asked for."""
        rows = []
        for text, (labels, accessions_) in self.text.items():
            docs = [{"resourcename": "gene", "title": "g"}] + [{"resourcename": "trait", "mappedTrait": x, "shortForm": ["E1"]} for x in [*labels, *labels[:1]]] + [{"resourcename": "study", "accessionId": f"GCST{a:06d}"} for a in accessions_]
            rows += [(f"{HOST}/text?q={quote_plus(text)}&max={most}", 200, json.dumps({"response": {"docs": docs if most == 40 else docs[: most + 1 + len(labels) + 1]}})) for most in {40, 2 * limit}]
        for label in self.labels:
            for old in (False, True):
                want = min(2 * limit * 8, 400) if old and sumstats_only else 2 * limit
                size, mine = min(want, 100), self.studies(label, old, sumstats_only)
                for page in range(-(-len(mine) // size) or 1):
                    part = mine[page * size : page * size + size]
                    made = [{"accessionId": f"GCST{a:06d}", "fullPvalueSet": has, "ancestries": [{"type": "initial", "numberOfIndividuals": a * 7 % 101 + 1}]} if old else {"accession_id": f"GCST{a:06d}", "full_summary_stats_available": has, "initial_sample_size": f"{a * 7 % 101 + 1} individuals"} for a, has in part]
                    base = f"{HOST}/v1/studies/search/findByEfoTrait?efoTrait=" if old else f"{HOST}/v2/studies?efo_trait="
                    flags = "" if old else "&show_child_trait=true" + ("&full_pvalue_set=true" if sumstats_only else "")
                    status = None if label in self.silent and not old else 500 if label in self.broken and not old else 200
                    rows.append((f"{base}{quote_plus(label)}{flags}&size={size}&page={page}", status, json.dumps({"_embedded": {"studies": made}, "page": {"totalPages": -(-len(mine) // size)}})))
        for a in {a for _, listed in self.text.values() for a in listed if a % 5}:  # every fifth is unknown to both routes
            rows.append((f"{HOST}/v2/studies/GCST{a:06d}", 200, json.dumps({"accession_id": f"GCST{a:06d}", "full_summary_stats_available": a % 3 == 0, "initial_sample_size": f"{a * 7 % 101 + 1} individuals"})))
        return rows

    def loop(self, text, limit, sumstats_only):
        """One search as a plain loop."""
        labels, listed = self.text[text]
        found, sick = {}, False
        for label in labels[:8]:
            if len(found) >= limit:
                break
            old = sick or label in self.broken or label in self.silent
            sick = sick or label in self.broken
            mine = self.studies(label, old, sumstats_only)
            if old and sumstats_only:
                mine = [x for x in mine[: min(16 * limit, 400)] if x[1]]
            for a, has in mine[: 2 * limit]:
                found.setdefault(a, (has, []))[1].append(label)
        if len(found) < limit:
            for a in listed[: 2 * limit]:
                if len(found) >= 2 * limit or a in found or a % 5 == 0 or (sumstats_only and a % 3):
                    continue
                found[a] = (a % 3 == 0, [])
        best = sorted(found, key=lambda a: (-found[a][0], -(a * 7 % 101 + 1)))[:limit]
        return [(f"GCST{a:06d}", found[a][0], found[a][1]) for a in best]


CASES = Catalogue(
    {"long one": range(100, 400), "short": [7, 9, 12], "other": [9, 21, 300], "none": [], "bad": range(500, 560), "quiet": range(600, 620)},
    {"many": (["long one", "short"], [1]), "few": (["short", "none", "other"], [31, 9, 30, 33, 36, 38, 41]), "bad first": (["bad", "quiet", "short"], []), "quiet": (["quiet", "short"], [3]), "nothing": ([], list(range(50, 90))), "no hits": ([], [])},
    broken=("bad",), silent=("quiet",),
)


@pytest.mark.parametrize("limit,sumstats_only", [(4, True), (60, False)])
def test_search_as_a_loop(spark, limit, sumstats_only):
    rows = CASES.answers(limit, sumstats_only)
    routes = Routes(settings.load(env={}, **PLACES), spark.createDataFrame(rows, "url string, status int, body string").coalesce(1))
    texts = spark.createDataFrame([(t, t) for t in CASES.text], "source_id string, text string").coalesce(1)
    found, left_out = searching.search(texts, routes, limit=limit, sumstats_only=sumstats_only, excludes=[])
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["source_id"], []).append((r["accession"], r["has_sumstats"], r["matched_traits"]))
    assert got == {t: want for t in CASES.text if (want := CASES.loop(t, limit, sumstats_only))}
    assert all(r["excluded"] == 0 for r in left_out.collect())


class Counting:
    """A transport that writes down when it is asked what; two studies on each of three pages of a trait."""

    log = Path("/tmp")

    def __init__(self, per_second, retries):
        self.gap, self.last = 1 / per_second, 0.0

    def request(self, method, url, headers, most):
        time.sleep(max(0.0, self.last + self.gap - time.monotonic()))
        self.last = time.monotonic()
        if "log=" in url:
            with open(url.split("log=")[1].split("&")[0], "a") as f:
                f.write(f"{time.time()} {method} {url}\n")
        return 200, {"content-length": "3"}, b"" if method == "HEAD" else b"abc"


@pytest.fixture(autouse=True, scope="module")
def importable(spark):
    spark.sparkContext.addPyFile(str(Path(__file__)))


def rate_of(log):
    at = sorted(float(x.split()[0]) for x in log.read_text().splitlines())
    return len(at), max(sum(1 for t in at if s <= t < s + 1.0) for s in at)


@pytest.mark.parametrize("tasks", [1, 3])
def test_the_rate_is_the_whole_jobs(spark, tmp_path, tasks):
    urls = [f"{HOST}/{i}?log={tmp_path}/a" for i in range(12)]
    assert read_prefixes(spark, urls, 3, transport="test_routes:Counting", requestsPerSecond=9.0, partitions=tasks).count() == 12
    asked, most = rate_of(tmp_path / "a")
    assert asked == 24 and most <= 9 + 2 * tasks  # a task's first request waits for nothing
    files = spark.createDataFrame([(str(i), f"{HOST}/{i}?log={tmp_path}/b") for i in range(12)], "source_id string, url string")
    got = probe_table(files, 3, "test_routes:Counting", 9.0, 0, tasks).collect()
    assert {(r["source_id"], bytes(r["content"]), r["category"]) for r in got} == {(str(i), b"abc", None) for i in range(12)}
    assert rate_of(tmp_path / "b")[1] <= 9 + 2 * tasks


def test_publications_traits_bibtex_and_release(spark):
    rows = [
        (f"{HOST}/v2/publications/5", 200, json.dumps({"title": "T", "journal": "NR", "publication_date": "2019-01-02", "first_author": {"full_name": "A B"}})), (f"{HOST}/v2/publications/6", 500, ""),
        (f"{HOST}/v1/studies/GCST1/efoTraits", 200, json.dumps({"_embedded": {"efoTraits": [{"trait": "x"}, {"trait": ""}, {"shortForm": "E"}]}})), (f"{HOST}/v1/studies/GCST2/efoTraits", 404, ""),
        ("https://doi.org/10.1/a", 200, "@article{a}"), (f"{HOST}/v2/metadata", 200, '{"release": "2024-01-01", "efo": 3}'),
    ]
    routes = Routes(settings.load(env={}, **PLACES), spark.createDataFrame(rows, "url string, status int, body string"))
    papers = spark.createDataFrame([("5",), ("6",), (None,)], "pubmed_id string")
    assert {tuple(r) for r in catalogue.publications(papers, routes).collect()} == {("5", "T", None, "2019-01-02", "A B", 2019), ("6", None, None, None, None, None)}
    wanted = spark.createDataFrame([("GCST1",), ("GCST2",)], "accession string")
    assert {r["accession"]: r["mapped_traits"] for r in catalogue.mapped_traits(wanted, routes).collect()} == {"GCST1": ["x"], "GCST2": None}
    dois = spark.createDataFrame([("10.1/a",), ("10.1/b",)], "doi string")
    assert {tuple(r) for r in catalogue.bibtex(dois, routes).collect()} == {("10.1/a", "@article{a}"), ("10.1/b", None)}
    assert catalogue.release(spark, routes).first()["release"] == {"release": "2024-01-01", "efo": "3"}


def test_run_from_the_catalogue(spark):
    rows = [*answers(), (f"{HOST}/text?q=x&max=40", 200, json.dumps({"response": {"docs": []}}))]
    rows.append((f"{HOST}/text?q=x&max=20", 200, json.dumps({"response": {"docs": [{"resourcename": "study", "accessionId": f"GCST{i:06d}"} for i in (3, 9, 4, 2, 1)]}})))
    routes = Routes(settings.load(env={}, **PLACES), spark.createDataFrame(rows, "url string, status int, body string").coalesce(1))
    got = searching.run(spark.createDataFrame([("s", "x")], "source_id string, text string"), routes, limit=10, excludes=[])
    assert [(r["accession"], r["verdict"], r["category"]) for r in got.orderBy("place").collect()] == [("GCST000001", "READY", None), ("GCST000002", "READY", None), ("GCST000009", "NOT_READY", None), ("GCST000004", "UNKNOWN", "file_not_found")]


class Served:
    """The stored answers over a transport."""

    def __init__(self, per_second, retries):
        self.known = {u: (s, b) for u, s, b in answers()}

    def request(self, method, url, headers, most):
        status, body = self.known.get(url, (404, ""))
        if status is None:
            raise OSError("no answer")
        data = (body or "").encode()[: most or 0]
        return (206 if "Range" in headers and status == 200 else status), {"content-length": str(len(body or ""))}, data


def test_commands(spark, tmp_path, capsys, monkeypatch):
    for key, value in {**PLACES, "transport": "test_routes:Served"}.items():
        monkeypatch.setenv("STATSIFT_" + key.upper(), value)
    command.main(["assess", "GCST000002", "gcst000004"])
    said = capsys.readouterr().out
    assert "READY" in said and "file_not_found" in said
    (tmp_path / "m.csv").write_text("accession,true_verdict,true_header,kind\nGCST000002,READY,SNP CHR,k\nGCST000004,READY,,k\n")
    command.main(["benchmark", str(tmp_path / "m.csv"), "--by", "kind", "--run", str(tmp_path / "run")])
    assert "0.5" in capsys.readouterr().out


def test_stream_of_files_that_cannot_be_read(spark, tmp_path):
    from statsift.streaming.drop_directory import arriving_files, run_available

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text(GOOD)
    (tmp_path / "in/b.tsv").write_text("x")
    stream = arriving_files(spark, str(tmp_path / "in"))
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "at"))
    first = {r["name"]: (r["kind"], r["category"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert first["a.tsv"] == ("DATA", None)
    (tmp_path / "in/c d.tsv").write_text(GOOD)
    (tmp_path / "in/gone.tsv").symlink_to(tmp_path / "in/later.tsv")
    run_available(arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"))
    second = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out")).select("name", "kind", F.octet_length("content").alias("n")).collect()}
    assert second["c d.tsv"]["kind"] == "DATA" and second["c d.tsv"]["n"] == len(GOOD)


sys.modules.setdefault("test_routes", sys.modules[__name__])
