import hashlib
import random

import numpy as np
import pytest

from statsift.llm import suffix_dedup as s


def brute_windows(pieces, length):
    seen, out = set(), []
    for k, p in enumerate(pieces):
        for i in range(len(p) - length + 1):
            w = p[i : i + length]
            if w in seen:
                out.append((k, i))
            seen.add(w)
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(250))])
@pytest.mark.parametrize("length", [3, 8, 20, 100])
def test_windows(alphabet, length):
    rng = random.Random(length * len(alphabet))
    base = bytes(rng.choice(alphabet) for _ in range(300))
    for _ in range(8):
        pieces = []
        for _ in range(rng.randint(1, 10)):
            a = rng.randint(0, 200)
            pieces.append(base[a : a + rng.randint(0, 130)] + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))))
        piece, place = s.repeated_windows(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), length)
        assert list(zip(piece.tolist(), place.tolist())) == brute_windows(pieces, length)


def test_order_and_prefixes():
    rng = random.Random(1)
    t = np.array([*(rng.choice([1, 2, 3, 256]) for _ in range(500)), 0], np.int16)
    order = s.suffix_array(t, 600)
    keys = [t[i:].tolist() for i in order if t[i]]
    assert keys == sorted(keys)
    prefixes = s.common_prefixes(t, order, 40)
    for j in range(2, len(order)):
        a, b = t[order[j - 1] :], t[order[j] :]
        n = min(len(a), len(b))
        equal = int(np.argmin(np.append(a[:n] == b[:n], False)))
        assert prefixes[j] == min(equal, 40)


def test_every_window_has_one_segment():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 900))) for _ in range(20)] + [b"a" * 5000, b""]
    who, start, windows, anchor, _ = s.segments(texts, 100)
    covered = sorted((w, x) for w, a, n in zip(who.tolist(), start.tolist(), windows.tolist()) for x in range(a, a + n))
    assert covered == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 99)]
    assert windows.max() <= 69
    keys = {}
    for w, a, n, h in zip(who.tolist(), start.tolist(), windows.tolist(), anchor.tolist()):
        for x in range(a, a + n):
            assert keys.setdefault(texts[w][x : x + 100], h) == h  # equal windows have equal anchors


def brute(rows, length=100):
    """Documents in order of id; rows of one id are versions of it."""
    first = {}
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in docs:
        data = text.encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            at = (doc is not None, doc or 0, i)
            first[w] = min(first.get(w, at), at)
    out = {}
    for doc, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (doc is not None, doc or 0, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT", hot)
    want = sorted((r[0] is not None, r[0] or 0, *brute(odd_rows)[r[0], r[1] or ""][:4]) for r in odd_rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.dedup(odd).collect())
    assert got == want


def test_texts_and_columns_stay(odd, odd_rows):
    out = s.remove_repeats(odd)
    assert out.columns == odd.columns
    want = brute(odd_rows)
    full = sorted(want[r[0], r[1] or ""][4].decode("utf-8", "ignore") for r in odd_rows)
    assert sorted(r["text"] or "" for r in out.collect()) == full


def test_empty(empty):
    assert s.dedup(empty).count() == 0 and s.remove_repeats(empty).count() == 0


def test_spans():
    assert s.merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
    assert s.without(b"0123456789", [(0, 2), (5, 6)]) == b"2346789"


def test_clashing_names_and_lengths(spark, odd_rows):
    """Columns under the operator's own working names stay; a length that a segment cannot hold is refused."""
    docs = spark.createDataFrame([(r[0], r[1], f"mine {i}", i) for i, r in enumerate(odd_rows)], "doc_id long, text string, __span_doc string, __spans int")
    out = s.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(r["__spans"] for r in out.collect()) == list(range(len(odd_rows)))
    for length in (0, 159):
        with pytest.raises(ValueError):
            s.dedup(docs, length)


def test_short_texts_alone(spark):
    """A table whose texts are all shorter than a window."""
    got = s.dedup(spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (None, "")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0)]


def test_a_very_long_text(spark):
    """Two megabytes of one text, of which the second half repeats."""
    rng = random.Random(4)
    half = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    got = s.dedup(spark.createDataFrame([(1, half + half), (2, "short")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got} == {1: (2_000_000, 1_000_000), 2: (5, 0)}


def test_texts_are_cut_into_segments_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    short = [rng.integers(97, 123, 4096).astype(np.uint8).tobytes() for _ in range(1024)]
    for texts in (short, [b"".join(short)]):
        tracemalloc.start()
        found = s.segments(texts, 100)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        windows = sum(len(t) - 99 for t in texts)
        assert found[2].sum() == windows and peak < 25 * windows
