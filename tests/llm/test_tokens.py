"""Encoders, transducer, counts, files and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statsift.llm import _common, _tokens, packing, token_counts, token_files, transducer
from statsift.llm._files import for_reading

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["a", "B", "é", "  ", " ", "\n", "\t", "　", "\x1c", "\x85", "'s", "1", "22", "##", "<|endoftext|>", "<|startoftext|>", "é", "İ", "ΑΣ", "字", "​", "\xa0", "½", "😀", "\r\n", "'", "\x00", "﻿"]


def library(path):
    t = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(vocab, name, odd_rows):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [r[1] for r in odd_rows]
    got = _tokens.PieceEncoder(vocab(name)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library(vocab(name))(texts)


BYTES = "byte_bpe_50k.json"


@pytest.mark.parametrize("name", FILES)
def test_long_words(vocab, name):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(9000)), "a" * 9001, "ab" * 5000, "".join(rng.choice(["ing", "tion", "the", "x"]) for _ in range(3000))]
    got = _tokens.PieceEncoder(vocab(name)).encode(words)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library(vocab(name))(words)


@pytest.fixture(scope="module")
def narrow(vocab):
    """Rules with a window of a few characters, so that most words are open ones."""
    return transducer.Rules(vocab(BYTES), window=5)


@pytest.mark.parametrize("chunk", [1, 2, 7, 100])
def test_chunks_and_windows_do_not_matter(vocab, narrow, chunk, odd_rows):
    rng = random.Random(chunk)
    texts = [r[1] for r in odd_rows if r[1] is None or len(r[1]) < 3000]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["".join(rng.choice([*"abc'slre ", "  ", "\n", "é", "字", "12", "!!", "'re", "<|", "<|endoftext|>"]) * rng.randint(1, 9) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    want = library(vocab(BYTES))(texts)
    for rules in (narrow, None):
        got = transducer.encode_stream(texts, vocab(BYTES), chunk, rules)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


@pytest.mark.parametrize("unit", ["etaoinshrdlu", "字漢語文", "0123456789", "=-*/#", " ", "\n", "é"])
def test_a_word_without_end(vocab, unit):
    """Texts of one open word: the state stays small, the ids are the library's."""
    rng = random.Random(7)
    text = "".join(rng.choice(unit) for _ in range(40_000))
    rules = transducer.rules_of(vocab(BYTES))
    assert 0 < rules.lookahead < 4096
    machine, out = transducer.Transducer(rules), []
    for at in range(0, len(text), 1000):
        out.append(rules.ids([machine.feed(text[at : at + 1000])])[0])
        assert len(machine.held) <= rules.window + 1000 and (machine.merger is None or len(machine.merger.held) <= machine.merger.window + rules.lookahead)
    out.append(rules.ids([machine.close()])[0])
    assert np.frombuffer(b"".join(out), "<u4").tolist() == library(vocab(BYTES))([text])[0]


def test_memory_of_a_long_text(vocab):
    """Megabytes without blanks go through a small state."""
    import tracemalloc

    rules = transducer.rules_of(vocab(BYTES))
    machine, part, n = transducer.Transducer(rules), "abcdefgh" * 12_500, 0
    n += len(rules.ids([machine.feed(part)])[0])
    tracemalloc.start()
    for _ in range(40):
        n += len(rules.ids([machine.feed(part)])[0])
        assert len(machine.held) <= rules.window and len(machine.merger.held) <= machine.merger.window + rules.lookahead
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 16 << 20


def test_other_files_are_refused(vocab):
    with pytest.raises(ValueError):
        transducer.Rules(vocab("word_bpe_49k.json"))


def test_decoder(vocab):
    t = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    rng = random.Random(3)
    for step in (1, 2, 1000):
        for _ in range(60):
            ids = [rng.randrange(50257) for _ in range(40)]
            assert transducer.decode_stream(np.array(ids, "<u4").tobytes(), vocab("byte_bpe_50k.json"), step) == t.decode(ids, skip_special_tokens=False)


def test_round_trip(odd, odd_rows, empty, vocab):
    path = vocab("byte_bpe_50k.json")
    ids = dict(zip([r[1] for r in odd_rows], library(path)([r[1] for r in odd_rows])))
    want = sorted(str((r[0], len(ids[r[1]]), hashlib.sha256(",".join(map(str, ids[r[1]])).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in odd_rows)
    assert sorted(str(tuple(r)) for r in transducer.round_trip(odd, path).collect()) == want
    assert transducer.round_trip(empty, path).count() == 0


def test_counts(spark, odd, odd_rows, empty, vocab, tmp_path):
    path, cache = vocab("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    ids = dict(zip([r[1] for r in odd_rows], library(path)([r[1] for r in odd_rows])))
    want = sorted(str((r[0], len((r[1] or "").encode()), len(ids[r[1]]), len(ids[r[1]]) > 50)) for r in odd_rows)
    for _ in range(2):  # the second time all counts are in the cache
        got = token_counts.count_tokens(odd, path, cache, 50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), 1001).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert (token_files.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_files(spark, odd, odd_rows, empty, vocab, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    path = vocab("word_bpe_49k.json")
    index = token_files.write_token_files(odd, path, f"file://{tmp_path}/ids")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(index).collect())
    texts = {}
    for r, ids in zip(odd_rows, library(path)([r[1] for r in odd_rows])):
        texts.setdefault(r[0], []).append(np.array([*ids, 1], "<u4"))
    at = 0
    assert [g[1] is not None for g in got] == sorted(g[1] is not None for g in got)
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in texts[doc_id]}
    known = [g[1] for g in got if g[1] is not None]
    assert known == sorted(known) and len(got) == len(odd_rows)
    one = index.orderBy("part").first()
    with for_reading(one["path"]) as f:
        reader = token_files.Reader(f)
        assert reader.head["ids"] == one["n_tokens"] == sum(len(reader.document(k)) for k in range(one["n_docs"]))
    assert token_files.read_token_files(token_files.write_token_files(empty, path, f"file://{tmp_path}/none")).count() == 0


def test_histogram_packing():
    rng = random.Random(1)
    for width in (8, 64):
        for _ in range(50):
            histogram = {rng.randint(1, width): rng.randint(1, 50) for _ in range(rng.randint(0, 12))}
            patterns = packing.pack_histogram(histogram, width)
            held = dict.fromkeys(histogram, 0)
            for count, pattern in patterns:
                assert sum(a * b for a, b in pattern) <= width
                for length, times in pattern:
                    held[length] += count * times
            assert held == histogram
            total = sum(a * b for a, b in histogram.items())
            assert sum(c for c, _ in patterns) <= 2 * total / width + 1  # no two packs could be joined


def test_shortest_pack_first_one_by_one():
    """The patterns hold as much as placing piece after piece into the shortest pack."""
    rng = random.Random(8)
    for width in (10, 64):
        for _ in range(60):
            histogram = {rng.randint(1, width): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
            packs: list[int] = []
            for length in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
                shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
                if shortest is None or packs[shortest] + length > width:
                    packs.append(length)
                else:
                    packs[shortest] += length
            got = sorted(sum(a * b for a, b in pattern) for count, pattern in packing.pack_histogram(histogram, width) for _ in range(count))
            assert got == sorted(packs)


def test_packing(odd, odd_rows, empty, vocab):
    path = vocab("byte_bpe_50k.json")
    got = packing.pack(odd, path, width=64).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for r, ids in zip(odd_rows, library(path)([r[1] for r in odd_rows])):
        whole = np.array([*ids, 0], "<u4")
        want += [str((r[0], a, len(whole[a : a + 64]), zlib.crc32(whole[a : a + 64].tobytes()), len(whole))) for a in range(0, len(whole), 64)]
    assert sorted(str((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])) for r in got) == sorted(want)
    assert packing.pack(empty, path).count() == 0


def test_a_worker_gives_the_tables_of_an_earlier_operator_back(vocab, monkeypatch):
    monkeypatch.setattr(_tokens, "_encoders", {})
    monkeypatch.setattr(_common, "remembered", [])
    path = vocab(FILES[0])
    batch = pa.table({"doc_id": [1], "text": ["some words"]}).to_batches()[0]
    pieces = _common.per_batch(packing._pieces, remembers=True, path=path, width=8, end_id=0)
    first, kept = list(pieces(iter([batch]))), _tokens.encoder(path)
    assert list(pieces(iter([batch]))) == first and _tokens.encoder(path) is kept  # the same operator goes on with them
    assert list(_common.per_batch(lambda b: b)(iter([batch]))) == [batch]
    assert not _tokens._encoders and not _common.remembered
