"""Scores of candidate lines against a plain loop over lines and delimiters."""

from __future__ import annotations

import csv
import io
import math
import re

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from statsift.operators import header
from statsift.vocabulary import Vocabulary

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
READS = r"(?i)[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+)?|\.\d+(_\d+)*(e[+-]?\d+)?|nan|inf|infinity)"
MISSING = {"na", "nan", "n/a", "#na", ".", "-", "null", "none", ""}
TEXTS = {
    "plain": "SNP\tCHR\tBP\tP\n" + "".join(f"rs{i}\t1\t{i}\t0.5\n" for i in range(20)),
    "comments": "## file\n# SNP,CHR,BP,P\n" + "".join(f"rs{i},1,{i},NA\n" for i in range(20)),
    "keys": "build: 37\nn=500\n\nmarker;p-value;beta;color\n" + "rs1;0.1;0.2;red\n" * 5 + "\n\n",
    "quotes": '"SNP","P value","a,b"\n' + '"rs1",0.5,"x,y"\n' * 9,
    "spaces": "  MarkerName   Allele1 Allele2  Effect\n" + " rs1  a  g 0.1\n" * 4,
    "numbers": "1\t2\t3\n4\t5\t6\n",
    "twice": "id|id|chr||pos\n" + "1|2|3||5\n" * 3,
    "one": "a b",
    "words": "alone\nagain\n",
    "empty": "",
    "long": "".join(f"x{i} y{i}\n" for i in range(260)) + "SNP P\nrs1 0.5\n",
}


def name_of(cell):
    plain = re.sub(r"""[\s\-.:;,/\\|()\[\]{}'"`+*#@!?%^&=<>~$]+""", "_", cell.casefold())
    return re.sub("_+", "_", plain).strip("_")


def cells_of(line, d):
    if d == " ":
        return line.split() or [""]
    if '"' in line:
        return [c.strip() for c in next(csv.reader(io.StringIO(line), delimiter=d, skipinitialspace=True), [""])]
    return [c.strip() for c in line.split(d)]


def data_like(cells):
    filled = [c for c in cells if c]
    return bool(filled) and sum(bool(re.fullmatch(NUMBER, c)) and c.lower() not in MISSING for c in filled) / len(filled) >= 0.4


def loop(text):
    """Every candidate's score: (delimiter's place, line) to score."""
    known = {r[0] for r in Vocabulary().rows()}
    rules = Vocabulary()
    lines = re.split("\r\n|\r|\n", text)
    lines = (lines[:-1] if len(lines) > 1 else lines)[:207]
    comment = [bool(re.match(r"\s*(#|!|;;|//)", x)) for x in lines]
    out = {}
    for o, d in enumerate(header.DELIMITERS):
        split = [cells_of(x, d) for x in lines]
        for i, line in enumerate(lines[:200]):
            cells = split[i]
            if not line.strip() or len(cells) < 2:
                continue
            n = len(cells)
            names = [name_of(c) for c in cells]
            filled = [x for x in names if x]
            mapped = sum(x in known or re.sub("^hm_", "", x) in known or any(x.endswith(s[0]) for s in rules.suffix_rules) or any(s[0] in x for s in rules.contains_rules) for x in filled) / n
            hits, numeric = sum(x in header.HINTS for x in names), sum(bool(re.fullmatch(READS, c)) for c in cells) / n
            after = [split[j] for j in range(i + 1, min(i + 8, len(lines))) if lines[j].strip() and not comment[j]]
            score = mapped * 6 + min(hits, 8) * 0.45 + (1 - numeric) * 3 - (4 if numeric > 0.5 else 0) + len(set(filled)) / max(len(filled), 1) * 1.5
            score += sum(len(a) == n for a in after) / len(after) * 3 + sum(map(data_like, after)) / len(after) * 3 if after else -1
            score += 1 if 3 <= n <= 200 else -0.5 if n == 2 else -2
            score -= (0.5 if mapped >= 0.5 else 2.5) if comment[i] else 0
            score -= 4 if "\t" not in line and (re.match(r"\s*[^\s=]+\s*=\s*\S", line) or re.match(r"\s*[^\s:]+: \s*\S", line)) else 0
            score += -0.5 * cells.count("") + max(0, 1 - 0.02 * i) + (0.3 if d == "\t" else 0)
            out[o, i] = score
    return out


def winner(scores):
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] <= 0:
        return None
    (o, i), best = ranked[0]
    clip = lambda x: min(max(x, 0), 1)
    lead = clip((best - ranked[1][1]) / 4) if len(ranked) > 1 else 1.0
    return i, header.DELIMITERS[o], round(0.7 * clip(best / 14) + 0.3 * lead, 4)


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(TEXTS.items()) + [(f"d{r['doc_id']}", r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").filter(F.length("text") < 3000).orderBy("doc_id").collect() if r["text"].isascii()]
    return dict(rows), spark.createDataFrame(rows, "source_id string, text string").repartition(4)


def test_scores(texts):
    known, df = texts
    got = {}
    for r in header.score_candidates(header.explode_lines(df)).select("source_id", "delim_ord", "line_idx", "score").collect():
        got.setdefault(r["source_id"], {})[r["delim_ord"], r["line_idx"]] = r["score"]
    for s, text in known.items():
        want = loop(text)
        assert set(got.get(s, {})) == set(want), s
        wrong = {k: (v, got[s][k]) for k, v in want.items() if not math.isclose(v, got[s][k], abs_tol=1e-9)}
        assert not wrong, (s, wrong)


def test_winners_by_lines_and_by_texts(texts):
    known, df = texts
    shape = lambda rows: {r["source_id"]: (r["header_row"], r["delimiter"], r["confidence"]) for r in rows}
    by_lines = shape(header.detect_headers(header.explode_lines(df)).collect())
    by_texts = shape(header.headers_of_texts(df).collect())
    want = {s: w for s, t in known.items() if (w := winner(loop(t)))}
    close = {s: (w[0], w[1]) for s, w in want.items()}
    assert by_lines == by_texts and {s: g[:2] for s, g in by_texts.items()} == close
    assert {s: (by_texts[s][2], w[2]) for s, w in want.items() if abs(by_texts[s][2] - w[2]) > 2e-4} == {}


def test_candidates_go_without_cells_and_the_winner_has_its_own(spark):
    text = "# note\n\xa0SNP CHR BP P\xa0\n" + "rs1 1 5 0.5\xa0\n" * 6
    lines = spark.createDataFrame([("a", text)], "source_id string, text string").select("source_id", header.numbered(header.physical_lines(F.col("text"))).alias("lines"))
    bare = lines.select(F.inline(header.scored_lines(F.col("lines"), cells=False)))
    whole = lines.select(F.inline(header.scored_lines(F.col("lines"))))
    assert "cells" not in bare.columns and sorted(bare.collect()) == sorted(whole.drop("cells").collect())
    assert {r["delimiter"] for r in bare.collect()} == {" "}
    gaps = lines.select("source_id", F.inline("lines")).withColumn("line_idx", F.col("line_idx") * 3)
    assert [(r["header_row"], r["header"]) for r in header.detect_headers(gaps).collect()] == [(3, ["SNP", "CHR", "BP", "P"])]
