"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to a fixed number of buckets.  One pass counts
the buckets over all documents (raw corpus) and over a trusted sample (target).
A document's score is the mean, over its n-grams, of the log ratio between the
target and the raw multinomial; every document is kept or not by one threshold,
so the same text always gets the same verdict.

Both multinomials are brought to the same mass and smoothed by ``SMOOTHING``
counts a bucket: buckets with little evidence pull a score towards 0, so small
corpora do not lose clean documents.

Bounded: the trusted sample is at most ``SAMPLE`` labelled ids, those with the
smallest hash; the driver and each task hold that and one number a bucket.

Defined cases: a null text has no words and fails the base rules; null ids and
repeated rows are scored like any others (a null id is never trusted); without
labels every ratio is 0; a score that equals the threshold is kept; a very long text
is held by one task with its words and eight bytes for each of their n-grams; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c

BUCKET_BITS = 14
SAMPLE = 50_000
SMOOTHING = 8.0
THRESHOLD = -0.1
LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
_ODD, _ODD_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_buckets(words: list[bytes], bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    grams = np.concatenate((h * _ODD, h[:-1] * _ODD + h[1:] * _ODD_2)) if len(words) else h
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = (h[:-2] * _ODD + h[1:-1]) * _ODD_2 + h[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(words), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return int(np.count_nonzero(again | np.roll(again, 1) | np.roll(again, 2)))  # no window starts at the last two words


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """The words, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def trusted_ids(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> np.ndarray:
    """At most ``sample`` ids of labelled good, not toxic documents."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    return np.array(sorted(r["id"] for r in good.orderBy(F.xxhash64("id"), "id").limit(sample).collect()), np.int64)


def log_ratios(docs: DataFrame, trusted: np.ndarray, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket, counted over all documents."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.forget()
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for k, text in enumerate(batch.column("text")):
                got = np.bincount(ngram_buckets((text.as_py() or "").encode().split(), bits), minlength=size)
                raw += got
                if good[k]:
                    target += got
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    rows = c.pick(docs, doc_id=id_col, text=text_col)
    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for r in counted.collect():  # one row a bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(size)
    return np.log(target + smoothing) - np.log(raw * (target.sum() / raw.sum()) + smoothing)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the score and the verdict of every document.

    The corpus is counted when this is called."""
    ratios = log_ratios(docs, trusted_ids(labels), id_col=id_col, text_col=text_col)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text"):
            words, *counts = base_counts(text.as_py())
            n = len(words)
            failed = n < LEAST_WORDS or 100 * counts[-1] > 50 * n
            got = float(ratios[ngram_buckets(words)].mean()) if n else 0.0
            rows.append((n, *counts, failed, not failed and got >= threshold, got))
        columns = [pa.array(x) for x in zip(*rows)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in SCORES.split(", ")])

    return c.pick(docs, doc_id=id_col, text=text_col).mapInArrow(c.per_batch(judge), SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that the rules and the score keep, with all their columns."""
    ratios = log_ratios(docs, trusted_ids(labels), id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        stay = []
        for text in batch.column(at):
            words, *counts = base_counts(text.as_py())
            n = len(words)
            stay.append(n >= LEAST_WORDS and 100 * counts[-1] <= 50 * n and float(ratios[ngram_buckets(words)].mean()) >= threshold)
        return batch.filter(pa.array(stay))

    return docs.mapInArrow(c.per_batch(judge), docs.schema)
