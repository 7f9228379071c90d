"""Work that takes long for its size is dealt over all tasks; what is read several times is made once."""

import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from statsift import cases
from statsift.functions import cells, names
from statsift.functions.folding import folded
from statsift.operators import archives, charsets, readiness, validation


def test_texts_of_a_small_file_are_dealt_out(spark):
    assert cases._part_texts(spark, DATA).rdd.getNumPartitions() > 1


def test_plain_names_go_the_short_way(spark):
    names = ["SNP", "Effect-Allele", "p.value", "a:b", "a_b", "0.05", "a..b", "-a", "a-", "a\n", "Ａ1", "é", "", "A b"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(cells.normalised_name(F.col("n"))).collect()]
    assert got == ["snp", "effect_allele", "p_value", "a_b", "a_b", "0_05", "a_b", "a", "a", "a", folded("Ａ1"), "e", "", "a_b"]


def test_data_tables_go_through_the_texts_once(spark):
    assert all("/statsift/headers-" in f for f in cases.c_data_tables(spark, DATA).inputFiles())


def test_many_places_are_not_sent_whole(spark, monkeypatch):
    monkeypatch.setattr(validation, "SENT_WHOLE", 1)
    got = cases.c_cross_findings(spark, DATA)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert got.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert all("/statsift/headers-" in f for f in cases.c_data_tables(spark, DATA).inputFiles())


def test_accessions_may_be_wider_than_six_digits(spark):
    rows = spark.createDataFrame([("GCST999500",), ("GCST1000000",), ("GCST1110001",), ("GCST000001",), ("GCST0999500",)], "a string")
    got = [r[0] for r in rows.select(names.accession_block(F.col("a"))).collect()]
    assert got == ["GCST999001-GCST1000000", "GCST0999001-GCST1000000", "GCST1110001-GCST1111000", "GCST000001-GCST001000", "GCST0999001-GCST1000000"]


def test_of_character_sets_with_the_same_text_the_first_listed_stays():
    same = "äôúý ôý äú".encode("cp1252")
    assert max(charsets.scores(same), key=lambda s: s[0])[1] == "cp1250" and charsets.guess(same)[0] == "cp1252"
    assert charsets.guess("příliš žluťoučký kůň".encode("cp1250"))[0] == "cp1250"


def test_accented_letters_in_a_row_are_no_characters_of_two_bytes():
    for text in ("Adoado éréréoi en. Leeux avec.\nthe end\n", "Chtiontre eux lesairéréé de vieau le dans oiou pour."):
        assert charsets.guess(text.encode("cp1252"))[0] == "cp1252", text
    for text in ("これは日本語の文章です。", "染色体\t位置\tp値", "漢字"):
        assert charsets.guess(text.encode("cp932"))[0] == "cp932"


def test_sidecars_are_dealt_out(spark):
    assert cases.c_sidecars(spark, DATA).rdd.getNumPartitions() > 1


def test_headers_of_parts_are_dealt_out(spark):
    assert cases._part_headers(spark, DATA).rdd.getNumPartitions() > 1


def test_files_are_copied_a_few_bytes_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"x" * 40, None, b"y" * 70, b"z" * 300, b"", b"w" * 10])], ["k", "content"])
    parts = list(archives.pieces(iter([batch, batch.slice(0, 0)]), "content", 100))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5]]


def test_more_parts_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(cases, "PARTS_A_TASK", 7)
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert cases._part_headers(spark, DATA).rdd.getNumPartitions() == -(-parts // 7) > 8


@pytest.mark.parametrize("query", [cases.c_requirements, cases.c_verdicts, cases.c_declared])
def test_what_a_source_has_stays_in_its_task(spark, query):
    plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(p_partkey" in plan and "Exchange hashpartitioning(source_id" not in plan


def test_alternatives_of_own_rules(spark):
    own = (("any", True, (("z", "n", "f"), ("z", "n"), ("b",), ("h",))), ("all", False, (("b", "b2"),)))
    names = {1: [("z", 0.9), ("n", 0.7), ("f", 0.95)], 2: [("z", 0.9), ("n", 0.8), ("b", 0.8)], 3: [("b", 0.7), ("h", 0.95), ("b2", 1.0)], 4: [("f", 1.0)]}
    rows = [(s, i, f"{c}{s}", c, "alias", sure) for s, columns in names.items() for i, (c, sure) in enumerate(columns)]
    mapped = spark.createDataFrame(rows, "source_id int, ordinal int, raw string, concept string, method string, confidence double")
    sources = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (5,)], "source_id int")
    got = {(r["source_id"], r["requirement"]): (r["confidence"], r["satisfied_by"]) for r in readiness.evaluate(mapped, sources, readiness.rule_table(spark, own)).collect()}
    any_of = {1: (0.7, ["z1", "n1", "f1"]), 2: (0.8, ["z2", "n2"]), 3: (0.95, ["h3"]), 4: (0.0, []), 5: (0.0, [])}
    all_of = {s: (0.7, ["b3", "b23"]) if s == 3 else (0.0, []) for s in any_of}
    assert got == {(s, "any"): v for s, v in any_of.items()} | {(s, "all"): v for s, v in all_of.items()}
