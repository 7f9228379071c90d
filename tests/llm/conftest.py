"""Fixtures of documents with every odd case at once."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, path string"


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "er", "tion", "an", "re", "é", "ß", "ing", "st", "ou", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, n) for n in (120, 150, 90, 200, 300, 4, 1, 60)]
    shared = prose(rng, 70)
    texts: list[str | None] = [None, "", " \n\t ", "x", *base]
    for b in base[:4]:
        words = b.split()
        words[len(words) // 2] = "changed"
        texts += [b, " ".join(words), b.upper() if b.isascii() else b]
    texts += [prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 30) for _ in range(5)]
    texts += ["aaaa" * 300, "ab" * 700, "word " * 400, "𝔘nicode é́ ﷽ ​ 字字字 " * 20, "<|endoftext|> a<|startoftext|>b", "Licensed under the MIT License.\nApache License, Version 2.0 CC BY-NC 4.0 cc by nc"]
    texts += [" ".join(base) * 8]
    rows = [(i * 3, t, "en", "s", len(t or ""), "clash", 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[8], rows[5], (None, base[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return lambda name: str(public_tokenizers.path(name))
