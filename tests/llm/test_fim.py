"""Fill-in-the-middle against a plain loop over code points."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statsift.llm import fim


def plain_loop(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(rows, got):
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=repr) == sorted(
        ((i, *plain_loop(i, t), t or "") for i, t in rows), key=repr
    )


def test_odd_documents(spark, odd, odd_rows):
    check([r[:2] for r in odd_rows], fim.restore(fim.transform(odd)).collect())


def test_empty(spark, empty):
    assert fim.restore(fim.transform(empty)).collect() == []


def test_markers_half_markers_and_long_texts(spark):
    rng = random.Random(3)
    texts = ["a<P>b", "<S>", "x<M", "<", "<P", ">", "<<P", "P>S>M>", "é" * 40, "字<字>字", "ab" * 40 + "<", "\x00\n\t", "the cat sat on the mat " * 200_000, "é1" * 1_500_000]
    texts += ["".join(rng.choice("<>PSMab é字𝔘\n") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.restore(fim.transform(df)).collect()
    check(rows, got)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab <>PSMé字𝔘́\n0", max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.booleans()), min_size=1, max_size=20), st.integers(0, 3))
def test_kernel_on_parts_of_a_batch(rows, skipped):
    """Cuts of all rows of a slice, held against the parts of each row."""
    texts = pa.array(["A<x"] * skipped + [r[0] for r in rows])[skipped:]
    drawn = [np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(len(rows), np.int64), np.array([0 if r[3] else 99 for r in rows])]
    got = fim.cut_batch(texts, drawn, 90, 20)
    back = fim.restore_batch(got["output"].cast(pa.string()), got["form"].cast(pa.string()))
    assert back.to_pylist() == [r[0] for r in rows]
    for (text, one, two, _), n, form, pre, mid in zip(rows, *(got[k].to_pylist() for k in ("n", "form", "prefix_chars", "middle_chars"))):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert n == len(units)
        if form != "plain":
            low, high = sorted((one % (n + 1), two % (n + 1)))
            assert (pre, mid) == (len("".join(units[:low])), len("".join(units[low:high])))


def test_only_the_named_columns(spark):
    df = spark.createDataFrame([("abc 1", 7, 5, "x")], "body string, key long, n long, form string")
    got = fim.transform(df, id_col="key", text_col="body").collect()
    assert [(r["doc_id"], r["n"]) for r in got] == [(7, 3)]


@pytest.mark.parametrize("seed", [2, 9])
def test_seed(spark, seed):
    rows = [(i, "one two three four") for i in range(30)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), seed=seed).collect()
    assert {(r["doc_id"], r["output"]) for r in got} == {(i, plain_loop(i, t, seed)[4]) for i, t in rows}
