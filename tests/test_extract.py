"""Whole files: what stands above the header goes by position, and what Spark cannot read is refused."""

import random

import pandas as pd
import pytest

from statsift.operators import extract

BODY = "SNP\tP\nrs1\t0.5\nSNP\tP\nrs2\t\u00e9\n"


def test_lines_above_the_header(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("made\tby\n\nsome lab\n" + BODY, encoding="latin-1")
    want = [("rs1", "0.5"), ("SNP", "P"), ("rs2", "é")]
    assert [tuple(r) for r in extract.read_table(spark, str(path), "\t", 3, ["SNP", "P"], "ISO-8859-1").collect()] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")  # several blocks
    try:
        assert sorted(map(tuple, extract.read_table(spark, str(path), "\t", 3, ["SNP", "P"], "ISO-8859-1").collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_utf16_is_refused(spark, tmp_path, monkeypatch):
    from statsift import __main__ as command

    monkeypatch.setattr(command.session, "build", lambda: spark)
    (tmp_path / "a.tsv").write_bytes(("\ufeff" + "SNP\tCHR\tP\nrs1\t1\t0.5\n" * 20).encode("utf-16-le"))
    with pytest.raises(SystemExit, match="unsupported_encoding"):
        command.main(["extract", str(tmp_path / "a.tsv"), str(tmp_path / "out")])


def written(rng, rows, delimiter, breaks):
    """A table with quoted cells: doubled quotes, delimiters, line breaks (also empty lines), stray quotes within cells."""
    inner = ['""', delimiter, "\n", "\n\n", "x", "y z", '""""'] if breaks else ['""', delimiter, "x"]
    lines = []
    for i in range(rows):
        cells = [f"r{i}"]
        for _ in range(3):
            kind = rng.random()
            if kind < 0.15:
                cells.append('"' + "".join(rng.choice(inner) for _ in range(rng.randint(0, 6))) + 'e"')
            elif kind < 0.25:
                cells.append(f'{i}" pipe')  # a quote that is none
            elif kind < 0.3:
                cells.append("")
            else:
                cells.append(str(rng.randint(0, 9**6)))
        lines.append(delimiter.join(cells))
    return "# about\nid" + delimiter + delimiter.join("abc") + "\n" + "\n".join(lines) + "\n"


@pytest.mark.parametrize("delimiter", ["\t", ",", "|"])
@pytest.mark.parametrize("breaks", [True, False])
@pytest.mark.parametrize("split", [300, 3000, 1 << 20])
def test_quoted_line_breaks_across_splits(spark, tmp_path, delimiter, breaks, split):
    path = tmp_path / "t.txt"
    path.write_text(written(random.Random(f"{delimiter}{breaks}"), 400, delimiter, breaks))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        table = extract.read_table(spark, str(path), delimiter, 1, ["id", "a", "b", "c"])
        got = {r[0]: tuple(x or "" for x in r[1:]) for r in table.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = pd.read_csv(path, sep=delimiter, skiprows=1, dtype=str, keep_default_na=False)
    assert got == {r[0]: tuple(r[1:]) for r in want.itertuples(index=False)} and len(got) == 400


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extract, "MOST_LINES", 50)
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,\"x\n" + "4,5\n" * 100)
    with pytest.raises(ValueError, match="unclosed_quote"):
        extract.read_table(spark, str(tmp_path / "t.csv"), ",", 0, ["a", "b"])
