"""Zip directories against ``zipfile``, and older character sets against Python's decoders."""

import io
import os
import random
import struct
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statsift.operators import archives, charsets, payload

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLE = "SNP\tCHR\tP\n" + "".join(f"rs{i}\t1\t0.{i}\n" for i in range(1, 4000))


def packed(entries, **options):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, text in entries:
            z.writestr(name, text)
    return data.getvalue()


def test_directories_as_zipfile_reads_them():
    rng = random.Random(1)
    for n in (0, 1, 3, 300):
        data = packed([(f"{'é' if rng.random() < 0.3 else ''}x{i}.txt", "y" * rng.randint(0, 999)) for i in range(n)])
        data += b"" if n != 3 else b""
        begin, length, count = archives.directory_place(data[-archives.TAIL_BYTES :], len(data))
        got = archives.directory_entries(data[begin : begin + length])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            want = [(i.filename, i.compress_type, bool(i.flag_bits & 1), i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
        assert got == want and count == n


def test_comments_and_what_is_no_zip():
    data = packed([("a.tsv", TABLE)])
    with_comment = data[:-2] + struct.pack("<H", 10) + b"PK\x05\x06" + bytes(6)
    assert archives.directory_place(with_comment, len(with_comment)) == archives.directory_place(data, len(data))
    assert archives.directory_place(b"PK\x05\x06 no end", 100) is None and archives.directory_place(b"", 0) is None
    assert archives.directory_entries(b"PK\x01\x02 short") == []


def test_wide_values():
    entry = archives.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 8, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + struct.pack("<HHQQQ", 1, 24, 7 << 33, 5 << 33, 9 << 33)
    assert archives.directory_entries(entry) == [("a", 8, False, 5 << 33, 7 << 33, 9 << 33)]
    end64 = archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 1000)
    locator = archives.AT64 + struct.pack("<IQI", 0, 1000 + len(entry), 1)
    tail = entry + end64 + locator + archives.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert archives.directory_place(tail, 1000 + len(tail)) == (1000, len(entry), 1)


class Serving:
    """A transport with ranges over files below a folder that the address names."""

    def __init__(self, per_second, retries):
        pass

    def request(self, method, url, headers, most):
        path = Path(url.removeprefix("http://h"))
        if not path.exists():
            return 404, {}, b""
        size, (a, _, b) = path.stat().st_size, headers["Range"].removeprefix("bytes=").partition("-")
        begin, end = (max(0, size - int(b)), size) if not a else (int(a), min(size, int(b) + 1))
        with open(path, "rb") as f:
            f.seek(begin)
            return 206, {"content-range": f"bytes {begin}-{end - 1}/{size}"}, f.read(end - begin)


@pytest.fixture(autouse=True, scope="module")
def importable(spark):
    spark.sparkContext.addPyFile(str(Path(__file__)))


@pytest.mark.parametrize("scheme", ["", "http://h"])
def test_two_ranges_find_the_member_behind_a_large_neighbour(spark, tmp_path, scheme):
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_STORED) as z:
        with z.open("notes/scan.bin", "w", force_zip64=True) as f:
            for _ in range(300):
                f.write(bytes(1 << 20))
        z.writestr(zipfile.ZipInfo("results/sumstats.tsv"), TABLE, zipfile.ZIP_DEFLATED)
    (tmp_path / "many.zip").write_bytes(packed([(f"docs/{i:05d}-{'x' * 60}.pdf", "") for i in range(1500)] + [("b.tsv", TABLE), ("a.txt", "no")]))
    (tmp_path / "none.zip").write_bytes(packed([("readme.md", "x")]))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 cut off")
    (tmp_path / "odd.zip").write_bytes(packed([("a.tsv", TABLE)]).replace(b"PK\x03\x04", b"PK\x03\x05"))
    names = ("large", "many", "none", "broken", "odd", "absent")
    files = spark.createDataFrame([(n, f"{scheme}{tmp_path}/{n}.zip") for n in names], "source_id string, url string")
    got = {r["source_id"]: r for r in archives.read_zips(files, 4096, transport="test_bytes:Serving").collect()}
    assert bytes(got["large"]["data"]).decode() == TABLE[:4096] and got["large"]["member"] == "results/sumstats.tsv"
    assert got["large"]["bytes_received"] <= archives.TAIL_BYTES + 4096 + 2048
    assert bytes(got["many"]["data"]).decode() == TABLE[:4096] and got["many"]["member"] == "b.tsv"
    assert {n: got[n]["category"] for n in names} == {"large": None, "many": None, "none": "no_matching_member", "broken": "no_directory", "odd": "decompression_error", "absent": "http_404" if scheme else "file_not_found"}


SAMPLES = {
    "cp1252": ["Le café à côté de l'école où l'été dernier nous étions très heureux", "Die schöne Straße führt über große Brücken für müde Füße", "El niño comió jamón en la habitación mañana por la mañana", "«Año» señor"],
    "cp1250": ["Zażółć gęślą jaźń i ciągle śnią się łąki", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Árvíztűrő tükörfúrógép és hűtőszekrény"],
    "cp1251": ["Съешь же ещё этих мягких французских булок", "Щастя приходить до їхньої хати, є ґрунт"],
    "cp932": ["これは日本語の文章です。データの列は染色体と位置です", "染色体\t位置\tp値"],
    "latin-1": ["Größe und Länge der Bäume, naïve façade"],
}


@pytest.mark.parametrize("charset", sorted(SAMPLES))
def test_samples_decode_as_python_does(charset):
    for text in SAMPLES[charset]:
        for whole in (text, "SNP\tCHR\n1\t2\n" * 50 + text, text.upper() if charset != "cp932" and "ß" not in text else text):
            got = payload.decode_one(whole.encode(charset))
            assert got["text"] == whole, (charset, got)


def test_documents_in_older_character_sets(spark):
    """All documents that have letters beyond ASCII and that the set can write: the text comes back."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    texts = [r["text"] for r in docs.collect()]
    tried = good = 0
    for text in texts:
        try:
            data = text.encode("cp1252")
        except UnicodeEncodeError:
            continue
        tried += 1
        good += payload.decode_one(data)["text"] == text
    assert tried >= 20 and good >= 0.98 * tried


def test_what_is_no_text_stays_as_before():
    assert payload.decode_one(b"\x81\x8d\x8f\x90 x")["encoding"] == "latin-1"
    assert payload.decode_one("é".encode())["encoding"] == "utf-8" and payload.decode_one(b"abc")["encoding"] == "ascii"
    assert payload.decode_one("染色体の位置".encode("cp932")[:-1])["text"] == "染色体の位"
    assert charsets.guess(b"\xff\xfe\x80\x81") is None


sys.modules.setdefault("test_bytes", sys.modules[__name__])
