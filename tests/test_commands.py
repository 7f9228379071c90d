"""Settings, the catalogue's routes by a transport without a network, unpacking, and the commands."""

import json
import lzma
import sys
import tarfile
import zipfile
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import pytest

from statsift import __main__ as command
from statsift import settings
from statsift.operators import extract
from statsift.sources import catalogue, download

TABLE = "# made up\nSNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n" + "".join(f"rs{i}\t1\t{i}\tA\tG\t0.1\t0.01\t0.5\n" for i in range(1, 40))


class Fake:
    """Answers from nowhere: five studies a page, two pages; the newer route knows GCST0001 alone."""

    def __init__(self, per_second, retries):
        assert per_second > 0 and retries >= 0

    def request(self, method, url, headers, most):
        parts, query = urlparse(url), parse_qs(urlparse(url).query)
        if parts.path.endswith("/studies") or "findByEfoTrait" in parts.path:
            if parts.path.startswith("/v2") and query.get("efo_trait") == ["broken"]:
                return 500, {}, b""
            page, size, old = int(query["page"][0]), int(query["size"][0]), parts.path.startswith("/v1")
            made = [{"accessionId": f"GCST{100 + i}", "fullPvalueSet": i % 3 == 0} if old else {"accession_id": f"GCST{i}", "full_summary_stats_available": True} for i in range(page * size, min(page * size + size, 150))]
            return 200, {}, json.dumps({"_embedded": {"studies": made}, "page": {"totalPages": -(-150 // size)}}).encode()
        last = parts.path.rsplit("/", 1)[-1]
        if parts.path.startswith("/v2/studies") and last == "GCST0001":
            return 200, {}, b'{"accession_id": "GCST0001", "disease_trait": "x"}'
        if parts.path.startswith("/v1/studies") and last == "GCST0002":
            return 200, {}, b'{"accessionId": "GCST0002"}'
        if last == "GCST0009":
            raise OSError("no answer")
        if "ids" in query:
            return 200, {}, json.dumps({"records": [{"doi": "10.1/" + query["ids"][0]}] if query["ids"][0] != "7" else [{}]}).encode()
        if parts.path.endswith("a.tsv-meta.yaml"):
            return 200, {}, b"gwas_id: GCST5\nsamples:\n  - sample_size: 12\n"
        return 404, {}, b""


@pytest.fixture
def made(monkeypatch):
    """Settings with the fake transport; its module is on the path of all workers."""
    return settings.load(env={}, transport="test_commands:Fake", api_v2="http://h/v2", api_v1="http://h/v1", citations="http://h/c")


@pytest.fixture(autouse=True, scope="module")
def importable(spark):
    spark.sparkContext.addPyFile(str(Path(__file__)))


def test_precedence(tmp_path):
    for name, text in (("s.yaml", "limit: 7\nretries: 9\nunknown: 1\n"), ("s.json", '{"limit": 7, "retries": 9}'), ("s.toml", "limit = 7\nretries = 9\n")):
        (tmp_path / name).write_text(text)
        got = settings.load(str(tmp_path / name), env={"STATSIFT_LIMIT": "8", "STATSIFT_OVERWRITE": "yes"}, probe_bytes=None)
        assert (got.limit, got.retries, got.overwrite, got.probe_bytes) == (8, 9, True, 262_144)
        assert settings.load(str(tmp_path / name), env={"STATSIFT_LIMIT": "8"}, limit=3).limit == 3
    with pytest.raises(ValueError):
        settings.load(env={"STATSIFT_OVERWRITE": "perhaps"})


def test_studies_by_accession(spark, made):
    wanted = spark.createDataFrame([(a,) for a in ("gcst0001 ", "GCST0002", "GCST0003", "GCST0009")], "accession string")
    got = {r["accession"]: (r["route"], r["category"]) for r in catalogue.studies_by_accession(wanted, made).collect()}
    assert got == {"GCST0001": ("v2", None), "GCST0002": ("v1", None), "GCST0003": (None, "not_found"), "GCST0009": (None, "api_error")}


def test_studies_by_trait(spark, made):
    got = catalogue.studies_by_trait(spark, "x", made, limit=130).collect()
    assert [r["accession"] for r in got] == [f"GCST{i}" for i in range(130)]  # in the route's order, over its pages
    old = catalogue.studies_by_trait(spark, "broken", made, limit=20, sumstats_only=True).collect()
    assert len(old) == 20 and all(r["has_sumstats"] for r in old)  # 20 of 150 need more than one page where the route cannot filter


def test_citations_and_sidecars(spark, made):
    papers = spark.createDataFrame([("5",), ("7",), (None,)], "pubmed_id string")
    assert {r["pubmed_id"]: r["doi"] for r in catalogue.citations(papers, made).collect()} == {"5": "10.1/5", "7": None}
    files = spark.createDataFrame([("a", "http://h/a.tsv"), ("b", "http://h/b.tsv")], "source_id string, url string")
    assert {r["source_id"]: r["sidecar_n"] for r in catalogue.fetch_sidecars(files, made).collect()} == {"a": 12, "b": None}


def packed_files(folder):
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("readme.pdf", "x" * 99)
        z.writestr("results/sumstats.tsv", TABLE)
    (folder / "t.tsv").write_text(TABLE)
    with tarfile.open(folder / "b.tar.gz", "w:gz") as t:
        t.add(folder / "t.tsv", "study/sumstats.tsv")
    (folder / "c.tsv.xz").write_bytes(lzma.compress(TABLE.encode()))
    return [("a.zip", "zip"), ("b.tar.gz", "tar.gz"), ("c.tsv.xz", "xz")]


def test_unpack(spark, tmp_path):
    packed = packed_files(tmp_path)
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../evil.tsv", TABLE)
    rows = [(str(tmp_path / n), c) for n, c in [*packed, ("evil.zip", "zip"), ("t.tsv", "rar")]]
    got = {Path(r["source_id"]).name: r for r in extract.unpack(spark.createDataFrame(rows, "source_id string, compression string"), str(tmp_path / "out")).collect()}
    assert all(Path(got[n]["path"]).read_text() == TABLE for n, _ in packed)
    assert got["evil.zip"]["category"].startswith("unsafe_member") and got["t.tsv"]["category"].startswith("unsupported")


@pytest.mark.parametrize("name", ["a.zip", "b.tar.gz", "c.tsv.xz", "t.tsv"])
def test_extract_command(spark, tmp_path, capsys, name):
    packed_files(tmp_path)
    out = tmp_path / "out.csv"
    command.main(["extract", str(tmp_path / name), str(out), "--rename", "--delimiter", "comma", "--max-rows", "5"])
    files = [out] if out.is_file() else sorted(out.glob("*.csv"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    assert lines[0].split(",")[:3] == ["variant_id", "chromosome", "position"] and len(lines) == 6
    with pytest.raises(SystemExit):
        command.main(["extract", str(tmp_path / name), str(out)])


def test_search_scan_and_benchmark(spark, tmp_path, capsys):
    packed_files(tmp_path)
    studies = spark.createDataFrame([(i, f"GCST{i:04}", "x", True, 100 * i, 0, 0, ["European"], str(tmp_path / "t.tsv"), 2020) for i in range(4)], "position long, accession string, trait string, has_sumstats boolean, n_total long, n_cases long, n_controls long, ancestries array<string>, url string, year int")
    studies.write.parquet(str(tmp_path / "studies"))
    command.main(["search", "--studies", str(tmp_path / "studies"), "--population", "eur", "--limit", "2"])
    assert "GCST0003" in capsys.readouterr().out
    command.main(["run", "--studies", str(tmp_path / "studies"), "--limit", "2", "--format", "csv", "--output", str(tmp_path / "run.csv")])
    command.main(["assess", str(tmp_path / "t.tsv"), str(tmp_path / "none.tsv")])
    said = capsys.readouterr().out
    assert "READY" in said and "file_not_found" in said
    command.main(["scan", str(tmp_path / "t.tsv"), "--emit-code"])
    assert "withColumnsRenamed" in capsys.readouterr().out
    (tmp_path / "m.csv").write_text("accession,predicted_verdict,true_verdict,predicted_header,true_header,kind\na,READY,READY,x,x,k\nb,PARTIAL,READY,x,y,k\n")
    command.main(["benchmark", str(tmp_path / "m.csv"), "--by", "kind"])
    assert "0.5" in capsys.readouterr().out


def test_download_stays_in_its_folder(spark, tmp_path):
    (tmp_path / "src.txt").write_text("abc")
    rows = spark.createDataFrame([(f"file://{tmp_path}/src.txt", "../out.txt", None)], "source_id string, name string, md5 string")
    got = download.download(rows, str(tmp_path / "in")).first()
    assert got["category"] is None and Path(got["path"]).parent == tmp_path / "in" and not (tmp_path / "out.txt").exists()


sys.modules.setdefault("test_commands", sys.modules[__name__])
