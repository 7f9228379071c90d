"""License scan, sharding, quality rules and media columns."""

import hashlib
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statsift.llm import licenses, media, quality, sharding


def license_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_base_places(spark, odd, odd_rows, empty):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    extra = [(9000, "under the mit license under the MIT-license: cc by-nc cc by nc", *[None] * 6), (9001, "APACHE license, version 2.0 apache license version 3", *[None] * 6)]
    docs = odd.union(spark.createDataFrame(extra, odd.schema))
    want = []
    for r in [*odd_rows, *extra]:
        w = license_words(r[1])
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.append(str((r[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))))
    got = licenses.scan(docs).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(want)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan(empty).count() == 0


def test_own_templates(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Permission is hereby granted, free of charge, to any person", "free of charge permission", "a gnu and a general license"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl", 1: "all-rights-reserved", 2: "mit", 3: "", 4: ""}


def test_shards(spark, odd, odd_rows, empty):
    got = sharding.shard(odd, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    for shard in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert sharding.shard(empty).count() == 0


def test_the_map_is_loaded_edited_and_appended(spark, odd, tmp_path):
    path = f"file://{tmp_path}/map"
    first = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(odd, shards=4, map_path=path).collect()}
    again = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(odd, shards=4, map_path=path).collect()}
    versions = {r["version"]: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()}
    assert versions == {1: sharding.SLOTS, 2: sharding.SLOTS, 3: sharding.SLOTS}
    assert first == again  # an even map needs no edit
    grown = sharding.shard(odd, shards=5, map_path=path).collect()
    assert {r["shard"] for r in grown} <= set(range(5)) and sum(first[r["doc_id"], r["text_crc32"]] != r["shard"] for r in grown) < len(grown)
    fewer = sharding.shard(odd, shards=2, map_path=path).collect()
    assert {r["shard"] for r in fewer} == {0, 1}
    for shard in range(2):
        assert sorted(r["slot"] for r in fewer if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in fewer)))


def test_an_id_with_most_rows(spark):
    rows = [(None if i % 3 else 7, f"text {i % 5}") for i in range(300)] + [(i, "x") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=3).collect()
    assert len(got) == 400
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_near_equal_sizes_and_few_moves():
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(8, 1, 8192).astype(int).tolist()
    old = sharding.first_map(40)
    new = sharding.rebalance(old, sizes, 40)
    total = np.bincount(new, weights=sizes, minlength=40)
    assert total.max() - total.min() <= max(sizes)
    assert (total.max() - total.min()) / total.mean() < 0.01
    assert sum(a != b for a, b in zip(old, new)) < 8192 / 4
    grown = sharding.rebalance(new, sizes, 41)
    assert all(a == b or b == 40 for a, b in zip(new, grown) if sizes) or np.bincount(grown, weights=sizes, minlength=41).max() <= total.max() + max(sizes)
    assert sharding.rebalance(sharding.first_map(3, 5), [0] * 5, 3) == sharding.first_map(3, 5)


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated)


def test_quality_base(spark, odd, odd_rows, empty):
    odd_text = "a b c a b c\n\n x\nx\n x\n$ #*<>|&%$ \x0b\x0c\x1c é é"
    docs = odd.union(spark.createDataFrame([(77, odd_text, *[None] * 6)], odd.schema))
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, None), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [*odd_rows, (77, odd_text)]
    got = quality.score(docs, labels).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:6]) for r in got) == Counter((r[0], *base(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert quality.score(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_against_plain_counts(odd, odd_rows, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 6)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    got = quality.log_ratios(odd, trusted, bits=10)
    raw, target = np.zeros(1024), np.zeros(1024)
    for r in odd_rows:
        counts = np.bincount(quality.ngram_buckets((r[1] or "").encode().split(), 10), minlength=1024)
        raw += counts
        if r[0] is not None and r[0] in trusted:
            target += counts
    want = np.log(target + 8) - np.log(raw * target.sum() / raw.sum() + 8)
    assert np.allclose(got, want)


def test_quality_separates_held_out_labels(spark):
    """Fitted on half of the labels, the verdict finds most bad documents of the other half and keeps the good ones."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(4)
    got = quality.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    good, bad = (got.filter(f"quality = {q} AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.98 and bad < 0.3


def test_media(spark, odd, odd_rows, empty, tmp_path):
    folder = f"file://{tmp_path}/media"
    got = media.media_columns(odd, folder).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((r[0], len((r[1] or "").encode())) for r in odd_rows)
    by_digest = {hashlib.sha256((r[1] or "").encode()).hexdigest(): (r[1] or "").encode() for r in odd_rows}
    values = {}
    for r in got:
        payload = media.padded(by_digest[r["digest"]])
        assert len(payload) % 64 == 0 and len(payload) == r["payload_bytes"] >= 64
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["width"], r["height"], r["bit_depth"], r["feature"]) == (64, len(payload) // 64, 8, media.features(payload))
        with open(r["media_path"].removeprefix("file://"), "rb") as f:
            f.seek(r["media_offset"])
            stored = f.read(r["media_bytes"])
        assert media.from_png(stored) == payload and hashlib.sha256(stored).hexdigest() == r["media_sha256"]
        assert values.setdefault(r["digest"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    for path in (tmp_path / "media").glob("*.tar"):
        with tarfile.open(path) as tar:
            for entry in tar:
                assert media.from_png(tar.extractfile(entry).read()) == media.padded(by_digest[entry.name.removesuffix(".png")])
    assert media.media_columns(empty, f"{folder}-none").count() == 0


def test_versions_are_stored_once_and_whole(spark, odd, tmp_path):
    path = f"file://{tmp_path}/map"
    assert sharding.last_version(spark, path) is None
    assert sharding.store_version(spark, path, 1, sharding.first_map(3, 64))
    assert not sharding.store_version(spark, path, 1, sharding.first_map(5, 64))  # another writer's version stays
    assert sharding.last_version(spark, path) == (1, sharding.first_map(3, 64))
    assert sorted(p.name for p in (tmp_path / "map").iterdir() if not p.name.startswith(".")) == ["version=1"]
    rows = sharding.shard(odd, shards=3, map_path=path).collect()
    assert max(r["virtual_slot"] for r in rows) < 64 and sharding.last_version(spark, path)[0] == 2
    # a writer that comes late edits what is there by then
    real, taken = sharding.store_version, []

    def late(spark, path, version, mapping):
        if not taken:
            taken.append(real(spark, path, version, [2 - s % 3 for s in range(64)]))
        return real(spark, path, version, mapping)

    sharding.store_version = late
    try:
        again = sharding.shard(odd, shards=3, map_path=path)
    finally:
        sharding.store_version = real
    assert taken == [True] and sharding.last_version(spark, path)[0] == 4
    assert again.count() == odd.count()
    spark.createDataFrame([(0, 1, 64), (0, 2, 64)], "virtual_slot int, shard int, slots int").write.parquet(f"{path}/version=9")
    with pytest.raises(ValueError, match="each of its 64 slots once"):
        sharding.last_version(spark, path)


def test_sizes_that_are_all_equal(spark):
    rows = [(i, "same") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shards=10, slots=512).groupBy("shard").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 16


def test_metadata_by_headers_alone(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/media"
    index = media.write_shards(odd, folder)
    whole = {r["digest"]: (r["media_offset"], r["media_bytes"], r["width"], r["height"], r["bit_depth"]) for r in media.read_back(index).collect()}
    # what is behind the headers may be anything: it is not read
    for shard in (tmp_path / "media").glob("*.tar"):
        data = bytearray(shard.read_bytes())
        for r in index.filter(index.path.endswith(shard.name)).collect():
            data[r["offset"] + media.HEADER : r["offset"] + r["length"]] = bytes(r["length"] - media.HEADER)
        shard.write_bytes(data)
    got = media.metadata(index).collect()
    assert {r["digest"]: (r["media_offset"], r["media_bytes"], r["width"], r["height"], r["bit_depth"]) for r in got} == whole and len(got) == len(whole)
    with pytest.raises(Exception, match="damaged PNG"):
        media.read_back(index).collect()


def test_columns_without_payloads_of_a_very_long_text(spark):
    rows = [(1, "x" * 3_000_000), (2, None), (3, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.media_columns(df, payloads=False).collect()}
    assert (got[1]["width"], got[1]["height"], got[2]["height"]) == (64, 3_000_000 // 64, 1) and got[1]["digest"] == got[3]["digest"]
    full = {r["doc_id"]: r["payload_bytes"] for r in media.media_columns(df).collect()}
    assert full == {1: 3_000_000, 2: 64, 3: 3_000_000}
