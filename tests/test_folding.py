"""Names fold as ``unicodedata`` folds them, over every code point and over strings."""

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from statsift.functions import folding
from statsift.functions.cells import normalised_name
from statsift.operators import mapping
from statsift.vocabulary import NAMES, Vocabulary


def test_every_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    blocks = [codes[i : i + 4096] for i in range(0, len(codes), 4096)]
    rows = [(i, [chr(c) for c in b]) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "i int, cs array<string>").repartition(8).select("i", F.posexplode("cs").alias("at", "c"))
    got = {(r["i"], r["at"]): r["f"] for r in df.select("i", "at", folding.fold(F.col("c")).alias("f")).collect()}
    wrong = [hex(c) for (i, at), f in got.items() if f != folding.folded(chr(c := blocks[i][at]))]
    assert wrong == [] and len(got) == len(codes)


def in_python(name):
    text = unicodedata.normalize("NFKD", (name or "").replace("﻿", "").strip())
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    return re.sub("_+", "_", re.sub(r"""[\s\-.:;,/\\|()\[\]{}'"`+*#@!?%^&=<>~$]+""", "_", text)).strip("_")


def test_names(spark):
    rng = random.Random(4)
    pool = "ＣＨＲ ﬁß½ǅ각힣가İıſKÅéé́ñ㍿ﷺ a_B-.:\t\x1c\x85 　 %1²"
    names = ["ＣＨＲ", "Straße", "﻿P-Value", "İ", None, "", "  "] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").repartition(4)
    got = {r["i"]: r["f"] for r in df.select("i", normalised_name(F.col("n")).alias("f")).collect()}
    assert [(n, got[i]) for i, n in enumerate(names) if got[i] != in_python(n)] == []


def test_names_that_must_not_pass_for_p_values(spark):
    raws = ["-log10_p_value", "_log10_p_value", "-log10(P-value)", "neg_log_10_p_value", "LOG10P", "ＣＨＲ", "joint_p_value"]
    got = {r["raw"]: (r["concept"], r["confidence"]) for r in mapping.map_columns(spark.createDataFrame([("x", i, r) for i, r in enumerate(raws)], "source_id string, ordinal int, raw string")).collect()}
    assert all(got[r] == ("neg_log10_p_value", 0.95) for r in raws[:5])
    assert got["ＣＨＲ"] == ("chromosome", 0.95) and got["joint_p_value"] == ("p_value", 0.72)


def test_a_vocabulary_refuses_names_that_no_header_can_have():
    for name in ("_p", "P", "p__v", "p v", "é"):
        with pytest.raises(ValueError, match="normal form"):
            Vocabulary(names={**NAMES, "beta": (name,)}).rows()
    assert Vocabulary(names={**NAMES, "beta": ("efecto_β", "染色体")}).rows()
