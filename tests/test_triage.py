"""Files of the shapes that occur in the wild, from bytes to verdicts."""

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from statsift.operators import header, mapping, payload, readiness, validation
from statsift.plans import triage
from statsift.sources.prefix import read_prefixes, read_url, with_transfer

ROWS = "".join(f"1\t{1000 + i}\trs{i}\tA\tG\t0.0{i % 9}1\t0.1\t0.5\n" for i in range(40))
PLAIN = "CHR\tPOS\tSNP\tA1\tA2\tBETA\tSE\tP\n" + ROWS


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    files = {
        "comments": write(d / "a.tsv", "# one\n# two\n" + PLAIN),
        "key_value": write(d / "b.txt", "study=x\ncount=4\nbuild=37\n\nMarkerName Allele1 Allele2 Effect  StdErr P-value N\n" + "".join(f"rs{i}  a g  0.1 0.2  0.5 {i + 9}\n" for i in range(20))),
        "quoted": write(d / "c.csv", '"variant_id","chromosome","base_pair_location","effect_allele","other_allele","beta","standard_error","p_value"\n' + "".join(f'"rs{i}","2","{i + 5}","C","T","0.1","0.2","0.3"\n' for i in range(20))),
        "latin": write(d / "d.tsv", ("# étude\n" + PLAIN).encode("latin-1")),
        "marked": write(d / "e.tsv", b"\xef\xbb\xbf" + PLAIN.encode()),
        "many": write(d / "f.tsv", "".join(f"note {i}\n" for i in range(25)) + "\n" + PLAIN),
        "ratio": write(d / "g.csv", PLAIN.replace("BETA", "OR").replace("\t", ";")),
        "packed": write(d / "h.tsv.gz", gzip.compress(PLAIN.encode())),
        "misnamed": write(d / "i.tsv.gz", PLAIN),
        "page": write(d / "j.tsv", "<!DOCTYPE html><html><body>gone</body></html>"),
    }
    out = {r["source_id"]: r for r in triage.scan(spark, list(files.values())).collect()}
    return {k: out.get(v) for k, v in files.items()}


@pytest.mark.parametrize(
    ("name", "row", "delimiter"),
    [("comments", 2, "\t"), ("key_value", 4, " "), ("quoted", 0, ","), ("latin", 1, "\t"), ("marked", 0, "\t"), ("many", 26, "\t"), ("ratio", 0, ";"), ("packed", 0, "\t"), ("misnamed", 0, "\t")],
)
def test_header_found(scanned, name, row, delimiter):
    r = scanned[name]
    assert (r["header_row"], r["delimiter"]) == (row, delimiter)
    assert r["verdict"] == "READY"


def test_page_is_no_data(scanned):
    assert scanned["page"] is None


def test_headerless_scores_low(spark):
    lines = header.explode_lines(spark.createDataFrame([("x", ROWS), ("y", PLAIN)], "source_id string, text string"))
    got = {r["source_id"]: r["confidence"] for r in header.detect_headers(lines).collect()}
    assert got.get("x", 0) < got["y"]


def test_zero_p_value_only_warns(spark):
    text = PLAIN.replace("\t0.5\n", "\t0\n")
    parts = triage.analyse(spark.createDataFrame([("x", text)], "source_id string, text string"))
    values = {r["concept"]: r["status"] for r in parts["values"].collect()}
    assert values["p_value"] == "WARN" and values["beta"] == "PASS"
    v = parts["verdicts"].first()
    assert (v["verdict"], v["uncertain"]) == ("PARTIAL", ["significance"])


def test_locus_under_chromosome(spark):
    rows = spark.createDataFrame([("x", i, [f"1:{i}", "A"]) for i in range(10)], "source_id string, row_idx int, cells array<string>")
    mapped = mapping.map_columns(mapping.explode_header(spark.createDataFrame([("x", ["CHR", "A1"])], "source_id string, header array<string>")))
    got = {r["concept"]: r for r in validation.validate(mapped, validation.tall_cells(rows)).collect()}
    assert got["chromosome"]["status"] == "FAIL" and got["chromosome"]["suggested_concept"] == "chromosome_position"
    assert got["effect_allele"]["status"] == "PASS"


def test_z_score_needs_companions(spark):
    frame = spark.createDataFrame([("a", ["SNP", "A1", "A2", "Z", "P"]), ("b", ["SNP", "A1", "A2", "Z", "P", "N", "EAF"])], "source_id string, header array<string>")
    got = {r["source_id"]: r["verdict"] for r in readiness.assess(mapping.map_columns(mapping.explode_header(frame))).collect()}
    assert got == {"a": "PARTIAL", "b": "READY"}


def _tar(name, data, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for n, d in (("study/readme.txt", b"hello"), (name, data)):
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    return out.getvalue()


def _zip(data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("paper.pdf", b"x" * 5000)
        z.writestr("results/sumstats.tsv", data)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["gzip", "two", "bzip2", "xz", "zstd", "zip", "tar", "tar.gz"])
def test_decompression(kind):
    import zstandard

    data = PLAIN.encode() * 50
    packed = {
        "gzip": lambda: gzip.compress(data), "two": lambda: gzip.compress(data[:500]) + gzip.compress(data[500:]), "bzip2": lambda: bz2.compress(data), "xz": lambda: lzma.compress(data),
        "zstd": lambda: zstandard.ZstdCompressor().compress(data), "zip": lambda: _zip(data), "tar": lambda: _tar("study/meta.tbl", data, "w"), "tar.gz": lambda: _tar("study/meta.tbl", data, "w:gz"),
    }[kind]()
    got = payload.decompress_one(packed, "gzip" if kind == "two" else kind)
    assert got["data"] == data and got["complete"]
    if kind in ("gzip", "zip", "tar", "tar.gz"):
        part = payload.decompress_one(packed[: len(packed) * 2 // 3], kind)
        assert data.startswith(part["data"]) and not part["complete"]


def test_magic_and_extension(spark):
    rows = [("a", gzip.compress(b"x"), "a.gz", "gzip"), ("b", _zip(b"x"), "b", "zip"), ("c", lzma.compress(b"x"), "c", "xz"), ("d", _tar("t.tsv", b"x", "w"), "d", "tar"), ("e", gzip.compress(b"x"), "e.tar.gz", "tar.gz"), ("f", b"CHR", "f.gz", None)]
    frame = spark.createDataFrame(rows, "id string, content binary, name string, want string")
    for r in frame.select("want", payload.compression_by_magic(F.col("content"), F.col("name")).alias("got"), payload.compression_by_extension(F.col("name")).alias("hint")).collect():
        assert r["got"] == r["want"]


def test_unsafe_members():
    assert all(map(payload.is_unsafe_member, ("../x", "/etc/x", "a/../../x", "C:\\x")))
    assert not payload.is_unsafe_member("a/b.tsv")


def test_missing_file_is_a_row(spark, tmp_path):
    r = with_transfer(read_prefixes(spark, [str(tmp_path / "none.tsv"), write(tmp_path / "x.tsv", "a" * 1000)], 100)).orderBy("size").collect()
    assert r[0]["category"] == "file_not_found" and r[0]["reduction"] is None
    assert r[1]["bytes_received"] == 100 and abs(r[1]["reduction"] - 0.9) < 1e-9


class Fake:
    """Answers by address: refuses ranges, misses, or serves."""

    def request(self, method, url, headers, most):
        if "gone" in url:
            return 404, {}, b""
        if method == "HEAD":
            return 200, {"content-length": "1000"}, b""
        if "Range" in headers and "norange" in url:
            return 416, {}, b""
        if "broken" in url:
            return 500, {}, b""
        return (206, {"content-range": "bytes 0-9/2000"}, b"0123456789"[:most]) if "Range" in headers else (200, {}, b"x" * most)


def test_transport():
    assert read_url("http://h/gone", 10, Fake())["category"] == "http_404"
    assert read_url("http://h/a", 10, Fake())["size"] == 2000
    plain = read_url("http://h/norange", 10, Fake())
    assert plain["content"] == b"x" * 10 and len(plain["attempts"]) == 3
    assert read_url("http://h/broken", 10, Fake())["category"] == "http_error"


def test_empty_input(spark):
    assert triage.scan_texts(spark.createDataFrame([], "source_id string, text string")).count() == 0
