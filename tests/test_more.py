"""Manifests, downloads, spreadsheets and the command line."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from statsift.functions import manifest
from statsift.sources import download


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("a\tb c", ["a", "b c"]), ("a, b|c", ["a", "b|c"]), ("a|b", ["a", "b"]), ("a b", ["a", "b"]), ("a", ["a"]), ("nan", None), ("", None)])
def test_header_cell(spark, text, want):
    assert value(spark, manifest.header_cell(F.lit(text))) == want


def test_other_cells(spark):
    assert value(spark, manifest.mapping_cell(F.lit("a=beta|b=|junk|a=p_value"))) == {"b": "unknown", "a": "p_value"}
    assert value(spark, manifest.mapping_cell(F.lit("junk"))) is None
    assert [value(spark, manifest.verdict_cell(F.lit(x))) for x in ("yes", "0", "not ready", "partial", "x", "none")] == ["READY", "NOT_READY", "NOT_READY", "PARTIAL", None, None]
    assert value(spark, manifest.integer_cell(F.lit("12,345.7"))) == 12345
    assert value(spark, manifest.boolean_cell(F.lit("Y"))) is True and value(spark, manifest.boolean_cell(F.lit("maybe"))) is None


def test_read_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('study_accession,true_header\nG1,"a,b"\nG2,\n')
    assert [tuple(r) for r in manifest.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("G1", "a,b"), ("G2", "")]


class Answer(io.BytesIO):
    def __init__(self, data, status):
        super().__init__(data)
        self.status = status


def test_download_resumes_and_verifies(tmp_path):
    data = b"0123456789" * 1000
    md5 = hashlib.md5(data).hexdigest()

    def serve(request):
        start = request.get_header("Range")
        return Answer(data[int(start[6:-1]) :], 206) if start else Answer(data, 200)

    path = str(tmp_path / "x")
    (tmp_path / "x.part").write_bytes(data[:123])
    assert download.fetch("http://h/x", path, md5, opener=serve)["category"] is None
    assert (tmp_path / "x").read_bytes() == data
    assert download.fetch("http://h/x", path, md5, opener=serve)["category"] == "exists"
    assert download.fetch("http://h/x", path, "0" * 32, overwrite=True, opener=serve)["category"] == "checksum_failed"
    assert (tmp_path / "x").read_bytes() == data

    def broken(request):
        raise OSError

    assert download.fetch("http://h/y", str(tmp_path / "y"), opener=broken)["category"] == "download_error"


def test_spreadsheet_without_reader(spark):
    r = download.read_spreadsheets(spark.createDataFrame([("a", b"no sheet")], "source_id string, content binary")).first()
    assert r["category"] in ("dependency_missing", "unsupported_format")


def test_command_line(spark, tmp_path, capsys):
    from statsift.__main__ import main

    (tmp_path / "a.tsv").write_text("# x\nSNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tP\n" + "".join(f"rs{i}\t1\t{i + 1}\tA\tG\t0.1\t0.1\t0.5\n" for i in range(9)))
    main(["scan", str(tmp_path / "a.tsv"), "--format", "csv", "--output", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["verdict"] == "READY"
    main(["extract", str(tmp_path / "a.tsv"), str(tmp_path / "clean"), "--rename"])
    table = spark.read.csv(str(tmp_path / "clean"), header=True, sep="\t")
    assert table.columns[:2] == ["variant_id", "chromosome"] and table.count() == 9


def test_only_the_columns_that_are_asked_for_are_validated(spark, monkeypatch):
    from helpers import DATA

    from statsift import cases

    monkeypatch.setattr(cases.validation, "validate", lambda mapped, cells: mapped)
    assert {r["concept"] for r in cases._validated(spark, DATA).select("concept").distinct().collect()} == {"p_value", "chromosome"}
