"""The queries over all rows, against plain Python."""

import csv
import io
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statsift import queries
from statsift.operators import header

TEXTS = {
    1: 'a,b,c\n1,"x,y",3\n4,"z ""q"", w",6\n',
    2: ',"a,b",c\n,"d,e",f\n',
    3: '"a;b";"c"d;e\n"x";y;z\n1;2;3\n',
    4: 'a|"open|b\n"c|d"|e\n',
    5: "plain\ttab\n1\t2\n\n# no\n3 4\t5\n",
    6: 'Größe,Fréquence "x"\nЧастота 頻度, "1,5"\n1 2 3\n',
    7: 'he said "so" and 1.5\n\n# "c"\nin 3 words\n',
}
NAMES = {1: "Fréquence Allélique", 2: "Частота (%)", 3: "頻度-値", 4: "P-value"}


def split(line, d):
    return line.split() if d == " " else [c.strip() for c in next(csv.reader(io.StringIO(line), delimiter=d, skipinitialspace=True), [])]


def lines_of(text):
    return text.split("\n")[:-1] or [text]


def usable(line):
    return line.strip() != "" and not re.match(r"\s*(#|!|;;|//)", line)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(NAMES.items()), "p_partkey long, p_name string").write.parquet(f"{at}/part.parquet")
    return at


def test_every_name(spark, tables):
    got = dict(tuple(r) for r in queries.q03_every_name(spark, tables).collect())
    assert set(got) == {f"d{i}" for i in TEXTS} | {f"p{i}" for i in NAMES}
    assert [got[f"p{i}"] for i in NAMES] == ["frequence_allelique", "частота", "頻度_値", "p_value"]
    assert got["d6"] == "grosse_frequence_x"  # case folding, as the names it is compared with


def test_every_delimiter(spark, tables):
    want = {}
    for i, text in TEXTS.items():
        first, best = [x for x in lines_of(text) if usable(x)][:20], None
        for o, d in enumerate(header.DELIMITERS):
            fields, n = Counter(len(split(x, d)) for x in first).most_common(1)[0]
            score = 10 * n / len(first) + 0.1 * min(fields, 30) + 0.35 * (o == 0)
            if fields > 1 and (best is None or score > best[0]):
                best = (score, d, fields, round(n / len(first), 4))
        if best:
            want[i] = best[1:]
    got = {r["doc_id"]: (r["delimiter"], r["fields"], r["confidence"]) for r in queries.q05_every_delimiter(spark, tables).collect()}
    assert got == want


def test_every_look_ahead(spark, tables):
    number = lambda v: bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v))
    want = set()
    for i, text in TEXTS.items():
        lines = lines_of(text)
        for at, line in enumerate(lines):
            after = [x for x in lines[at + 1 : at + 8] if usable(x)]
            if line.strip():
                cells = line.split()
                want.add((i, at, len(cells), sum(map(number, cells)), len(after), sum(len(x.split()) == len(cells) for x in after)))
    assert {tuple(r) for r in queries.q06_every_look_ahead(spark, tables).collect()} == want


def test_quoted_cells(spark):
    lines = [x for text in TEXTS.values() for x in lines_of(text) if '"' in x] + ['"a" , "b""', '"', '""', ',"",', 'a "b,c" d', ' "x, y" ,z', '\t"a,b"']
    for d in "\t,;|":
        got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", header.split_line(F.col("line"), F.lit(d)).alias("cells")).collect()
        assert {r["line"]: r["cells"] for r in got} == {x: split(x, d) for x in lines}
