"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from statsift.functions import cells, names
from statsift.operators import ancestry, catalog, discovery, evaluate, extract, resolver, samples
from statsift.sources import sinks
from statsift.vocabulary import Vocabulary


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("P-Value", "p_value"), ("  Effect Allele  ", "effect_allele"), ('"OR(A1)"', "or_a1"), ("﻿CHR", "chr"), ("Fréquence", "frequence"), ("__x__", "x"), (None, "")])
def test_normalised_name(spark, name, want):
    assert value(spark, cells.normalised_name(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("12,345", 12345), ("about 40", 40), ("1.5e-8", None), ("0.75", None), ("", None), ("none", None)])
def test_parse_count(spark, text, want):
    assert value(spark, cells.parse_count(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("1.2G", 1288490188), ("650", 650), ("-", None), ("378M", 396361728)])
def test_size_label(spark, text, want):
    assert value(spark, names.parse_size_label(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("GCST90038646", "GCST90038001-GCST90039000"), ("GCST000028", "GCST000001-GCST001000"), ("x", None)])
def test_accession_block(spark, text, want):
    assert value(spark, names.accession_block(F.lit(text))) == want


def test_urls(spark):
    assert value(spark, names.normalised_url(F.lit("ftp://ftp.ebi.ac.uk/a"))) == "https://ftp.ebi.ac.uk/a"
    assert value(spark, names.normalised_url(F.lit("ftp://example.org/a"))) is None
    assert value(spark, names.share_url(F.lit("https://www.dropbox.com/s/a/b.txt?dl=0"))) == "https://www.dropbox.com/s/a/b.txt?dl=1"
    assert value(spark, names.is_direct_url(F.lit("mailto:a@b"))) is False


@pytest.mark.parametrize(
    ("text", "cases", "controls", "total"),
    [
        ("7,310 Japanese ancestry cases, 9,005 Japanese ancestry controls", 7310, 9005, 16315),
        ("1,000 European ancestry individuals", None, None, 1000),
        ("500 variants in 20 genes", None, None, None),
        ("100 cases, 100 cases, 50 Asian cases", 150, None, None),
    ],
)
def test_counts(spark, text, cases, controls, total):
    s = value(spark, samples.count_from_text(F.lit(text)))
    assert (s["cases"], s["controls"], s["total"]) == (cases, controls, total)


def test_layers_of_samples(spark):
    schema = "study_n long, study_cases long, study_controls long, sidecar_n long, sidecar_cases long, sidecar_controls long, initial_sample string, replication_sample string, title string"
    rows = [(None, None, None, 0, None, None, "10 cases, 20 controls", "99 cases, 98 controls", None), (7, None, None, 8, None, None, "500 individuals", None, None), (None,) * 6 + (None, None, None)]
    a, b, c = samples.resolve_samples(spark.createDataFrame(rows, schema)).collect()
    assert (a["cases"]["value"], a["controls"]["value"], a["total"]["value"]) == (10, 20, 30)
    assert (b["total"]["value"], b["total"]["source"]) == (7, "structured")
    assert c["total"] is None and c["cases"] is None


def test_population(spark):
    score = lambda want, have: value(spark, ancestry.match_score(F.lit(want), F.array(*map(F.lit, have)) if have else F.array().cast("array<string>")))["score"]
    assert score("eur", ["European"]) == 1.0
    assert score("european", ["European", "East Asian"]) == 0.75
    assert score("european", []) == 0.4 and score("european", ["NR"]) == 0.4
    assert score("european", ["East Asian"]) == 0.0


def test_vocabulary_has_no_double_claim():
    rows = Vocabulary().rows()
    assert len({r[0] for r in rows}) == len(rows)
    with pytest.raises(ValueError, match="claimed"):
        Vocabulary(names={"beta": ["b"], "position": ["b"]}).rows()


def test_listing_and_best_file(spark):
    page = """<tr><td><a href="../">up</a></td><td> </td><td>-</td></tr><tr><td><a href="GCST1.tsv.gz">GCST1.tsv.gz</a></td><td>2024-01-01</td><td>1.2G</td></tr>
    <tr><td><a href="md5sum.txt">md5sum.txt</a></td><td>2024</td><td>1K</td></tr><tr><td><a href="GCST1.h.tsv.gz">x</a></td><td>2024</td><td>300M</td></tr>"""
    entries = resolver.list_entries(spark.createDataFrame([("s", page)], "source_id string, html string"))
    assert [r["name"] for r in entries.orderBy("ordinal").collect()] == ["GCST1.tsv.gz", "md5sum.txt", "GCST1.h.tsv.gz"]
    full = entries.withColumns({"harmonised": F.contains("name", F.lit(".h.")), "accession": F.lit("GCST1")})
    assert resolver.resolve_files(full).first()["name"] == "GCST1.h.tsv.gz"
    assert resolver.resolve_files(full, "no").first()["name"] == "GCST1.tsv.gz"


def test_checksums(spark):
    sums = resolver.parse_checksums(spark.createDataFrame([("d", "0123456789abcdef0123456789ABCDEF  ./a/x.tsv\nnonsense\n")], "directory string, text string"))
    assert sums.first().asDict() == {"directory": "d", "name": "x.tsv", "md5": "0123456789abcdef0123456789abcdef"}


def test_search_order(spark):
    schema = "accession string, trait string, position int, ancestries array<string>, has_sumstats boolean, n_total long, n_cases long, n_controls long"
    rows = [("a", "x", 0, ["East Asian"], True, 9, None, None), ("b", "x", 1, ["European"], None, 9, None, None), ("c", None, 2, ["European"], True, None, 4, 5), ("d", "Gene-based burden test", 3, ["European"], True, 99, None, None)]
    got = [r["accession"] for r in discovery.search(spark.createDataFrame(rows, schema), "european", 5).collect()]
    assert got == ["c", "b"]


def test_undefined_rates_are_null(spark):
    rows = spark.createDataFrame([(None, True), (False, True), (True, None)], "p boolean, t boolean")
    r = evaluate.confusion(rows, F.col("p"), F.col("t")).first()
    assert (r["tp"], r["fn"], r["precision"], r["specificity"], r["recall"]) == (0, 2, None, None, 0.0)


def test_circular_manifest(spark):
    same = spark.createDataFrame([(f"G{i}", "a", "a") for i in range(3)], "accession string, predicted_header string, true_header string")
    assert [r["message"] for r in evaluate.manifest_messages(same).collect()] == ["labels equal the predictions in every row"]


def test_sidecar(spark):
    text = "gwas_id: G1\nfile_type: GWAS-SSF v0.1\nis_harmonised: 'yes'\nsamples:\n- sample_ancestry_category: [European]\n  sample_size: 10\n  case_count: 0\n- sample_ancestry_category: [European, Asian]\n  sample_size: 5\n"
    r = catalog.sidecars(spark.createDataFrame([("s", text), ("t", ": : :"), ("u", None)], "source_id string, text string")).orderBy("source_id").collect()
    assert (r[0]["sidecar_n"], r[0]["sidecar_cases"], r[0]["ancestries"], r[0]["is_harmonised"]) == (15, None, ["European", "Asian"], True)
    assert r[1]["accession"] is None and r[2]["sidecar_n"] is None


def test_catalogue_routes(spark):
    v2 = catalog.studies_v2(spark.createDataFrame([('{"accession_id":"A","disease_trait":"NA","publication_date":"2019-04-01"}',)], "body string")).first()
    v1 = catalog.studies_v1(spark.createDataFrame([('{"accessionId":"B","cohort":"X|Y","diseaseTrait":{"trait":"t"}}',)], "body string")).first()
    assert (v2["accession"], v2["trait"], v2["year"]) == ("A", None, 2019)
    assert (v1["accession"], v1["trait"], v1["cohorts"]) == ("B", "t", ["X", "Y"])


def test_extract(spark, tmp_path):
    (tmp_path / "x.txt").write_text("SNP  P\nrs1  0.5\n rs2   1\n")
    spaced = extract.read_table(spark, str(tmp_path / "x.txt"), " ", 0, ["SNP", "P"])
    assert [tuple(r) for r in spaced.collect()] == [("rs1", "0.5"), ("rs2", "1")]
    table, report = extract.clean(spark.createDataFrame([('"a" ', "1"), ("b", "2")], "x string, y string"), {"x": "name"})
    assert [r["name"] for r in table.collect()] == ["a", "b"]
    assert {(r["name"], r["column"], r["rows_affected"]) for r in report.collect()} == {("strip_white_space", "x", 1), ("strip_quotes", "x", 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "k int, v array<string>, n string")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "k", "other"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().asDict() == {"v": "a|b", "k": "1", "other": None}
    sinks.write_json(df, str(tmp_path / "j"), "test", sinks.provenance(x=1))
    assert '"n":null' in spark.read.text(str(tmp_path / "j")).first()[0]
    assert "<td>a|b</td>" in sinks.render_page("t", ("one", df))


def test_stream(spark, tmp_path):
    from statsift.streaming import drop_directory

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("CHR\tP\n1\t0.5\n")
    (tmp_path / "in" / "b.tsv").write_text("<html></html>")
    drop_directory.run_available(drop_directory.arriving_files(spark, str(tmp_path / "in")).drop("content"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {r["name"]: r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.tsv": "DATA", "b.tsv": "NON_DATA"}
