"""What are these bytes?  Classification, decompression of prefixes, encodings.

Tests that only look are expressions; what must inflate bytes is a vectorised
function over bounded prefixes."""

from __future__ import annotations

import bz2
import codecs
import lzma
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statsift.functions.names import DATA_SUFFIXES
from statsift.operators.charsets import guess

# What opens a page of markup, and content types that are no data.
OPENERS = ("<!doctype html", "<html", "<head", "<body", "<meta", "<?xml", "<!--", "<script", "<title", "<div", "<span", "<svg")
NO_DATA_TYPES = ("text/html", "application/xhtml", "application/xml", "text/xml", "application/json", "application/pdf", "image/", "video/", "audio/")
TAG = r"<\s*/?\s*[a-zA-Z][a-zA-Z0-9]*[\s>/]"
SNIFF, OPENING, LEAST_TAGS, CONTROL_SHARE = 2048, 512, 3, 0.02
# Magic numbers and extensions, the more special first.
MAGIC = (("504B0304", "zip"), ("504B0506", "zip"), ("FD377A585A00", "xz"), ("425A68", "bzip2"), ("28B52FFD", "zstd"), ("1F8B", "gzip"))
EXTENSIONS = ((".tar.gz", "tar.gz"), (".tar.bz2", "bzip2"), (".tar.xz", "xz"), (".tgz", "tar.gz"), (".bgz", "bgzf"), (".gz", "gzip"), (".zip", "zip"), (".tar", "tar"), (".bz2", "bzip2"), (".xz", "xz"), (".zst", "zstd"))
MOST_OUTPUT = 8 << 20
MEMBER_HOPS = 64
NOISE = ("readme", "license", "manifest", "__macosx", ".ds_store", ".pdf", ".md", ".html", ".yaml", ".json")


def opens_as_markup(text: Column) -> Column:
    """The opener that a text starts with, if any."""
    start = F.lower(F.substring(F.regexp_replace(text, "^[﻿ \t\r\n]+", ""), 1, OPENING))
    out = F.lit(None).cast("string")
    for opener in reversed(OPENERS):
        out = F.when(F.startswith(start, F.lit(opener)), F.lit(opener)).otherwise(out)
    return out


def tag_count(text: Column) -> Column:
    """Tags in what is sniffed."""
    return F.size(F.regexp_extract_all(F.substring(text, 1, SNIFF), F.lit(TAG), F.lit(0)))


def markup_reason(text: Column) -> Column:
    """Why a text is markup, or NULL."""
    return F.coalesce(opens_as_markup(text), F.when(tag_count(text) >= LEAST_TAGS, F.lit("tags")))


def is_textual(text: Column) -> Column:
    """A byte-order mark of UTF-16 or UTF-32, or no NUL and next to no control characters in what is
    sniffed (bytes as Latin-1)."""
    head = F.substring(text, 1, SNIFF)
    marked = F.startswith(head, F.lit("\u00ff\u00fe")) | F.startswith(head, F.lit("\u00fe\u00ff")) | F.startswith(head, F.lit("\x00\x00\u00fe\u00ff"))
    control = F.length(F.regexp_replace(head, "[^\\x01-\\x08\\x0e-\\x1f\\x7f]", ""))
    return marked | ~head.contains("\x00") & (F.coalesce(F.try_divide(control, F.length(head)), F.lit(0.0)) <= CONTROL_SHARE)


def compression_by_magic(content: Column, name: Column) -> Column:
    """The compression that the bytes show; the name only tells a tar within gzip."""
    out = F.lit(None).cast("string")
    ustar = F.substring(content, 258, 5) == F.unhex(F.lit("7573746172"))
    out = F.when(ustar, F.lit("tar")).otherwise(out)
    extra = (F.substring(content, 4, 1).cast("binary") == F.unhex(F.lit("04"))) & (F.substring(content, 13, 2) == F.unhex(F.lit("4243")))
    for magic, kind in reversed(MAGIC):
        if kind == "gzip":
            value = F.when(extra, "bgzf").when(F.lower(name).rlike(r"\.(tar\.gz|tgz)$"), "tar.gz").otherwise("gzip")
        else:
            value = F.lit(kind)
        out = F.when(F.startswith(content, F.unhex(F.lit(magic))), value).otherwise(out)
    return out


def compression_by_extension(name: Column) -> Column:
    """What a name alone suggests."""
    out = F.lit(None).cast("string")
    for suffix, kind in reversed(EXTENSIONS):
        out = F.when(F.endswith(F.lower(name), F.lit(suffix)), F.lit(kind)).otherwise(out)
    return out


def classify(files: DataFrame) -> DataFrame:
    """``source_id, name, content, content_type`` with ``kind, reason, compression, recoverable``.

    Kinds in order: EMPTY; DATA where magic shows compression; NON_DATA for markup,
    then for a content type; CONTENT_MISMATCH where the name promises compression
    that the bytes do not have; DATA."""
    text = F.decode(F.substring("content", 1, SNIFF), "ISO-8859-1")
    magic, hint = compression_by_magic(F.col("content"), F.col("name")), compression_by_extension(F.col("name"))
    typed = F.lower(F.coalesce("content_type", F.lit(""))).rlike("^(" + "|".join(NO_DATA_TYPES) + ")")
    reason = F.regexp_replace(text, "^ï»¿", "")
    out = files.withColumns({"magic": magic, "markup": markup_reason(reason), "typed": typed, "textual": is_textual(text)})
    kind = (
        F.when(F.length("content") == 0, "EMPTY").when(F.col("magic").isNotNull(), "DATA").when(F.col("markup").isNotNull() | F.col("typed"), "NON_DATA")
        .when(hint.isNotNull(), "CONTENT_MISMATCH").otherwise("DATA")
    )
    out = out.withColumn("kind", kind).withColumn("compression", F.coalesce("magic", F.lit("none")))
    return out.withColumn("recoverable", (F.col("kind") == "CONTENT_MISMATCH") & F.col("textual")).drop("magic", "typed", "textual")


# --- decompression of prefixes ----------------------------------------------


def _inflate(data: bytes, most: int) -> tuple[bytes, bool, int]:
    """Members of a gzip stream one after another; a cut end is normal."""
    out, at, whole = [], 0, False
    size = 0
    while at < len(data) and size < most and data[at : at + 2] == b"\x1f\x8b":
        machine = zlib.decompressobj(31)
        try:
            got = machine.decompress(data[at:], most - size)
        except zlib.error:
            break
        out.append(got)
        size += len(got)
        whole = machine.eof
        if not machine.eof:
            at = len(data)
            break
        at = len(data) - len(machine.unused_data)
    return b"".join(out), whole, at


def _stream(machine, data: bytes, most: int) -> tuple[bytes, bool, int]:
    out, at = [], 0
    size = 0
    while at < len(data) and size < most:
        try:
            got = machine.decompress(data[at : at + 4096])
        except (OSError, lzma.LZMAError, EOFError, ValueError):
            break
        out.append(got)
        size += len(got)
        at += 4096
        if getattr(machine, "eof", False):
            break
    return b"".join(out)[:most], bool(getattr(machine, "eof", False)), min(at, len(data))


def is_noise(name: str) -> bool:
    """A directory, documentation or a system's own file."""
    low = name.lower()
    base = low.rstrip("/").rsplit("/", 1)[-1]
    return low.endswith("/") or base.startswith("._") or any(x in low for x in NOISE)


def is_unsafe_member(name: str) -> bool:
    """A name that would leave the folder it is extracted to."""
    return name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or name[1:2] == ":"


def pick_member(names: list[str]) -> str | None:
    """The member most likely to be data: by extension in order of preference, then the first."""
    kept = [n for n in names if not is_noise(n)]
    ranks = {s: i for i, s in enumerate(DATA_SUFFIXES)}
    key = lambda n: next((i for s, i in ranks.items() if n.lower().removesuffix(".gz").endswith(s)), len(ranks))
    return min(kept, key=key, default=None)


def _zip_member(data: bytes, most: int) -> tuple[bytes, bool, str | None]:
    """A member of a zip prefix, by its local headers."""
    at, found = 0, {}
    for _ in range(MEMBER_HOPS):
        if data[at : at + 4] != b"PK\x03\x04" or at + 30 > len(data):
            break
        flags, method = struct.unpack_from("<HH", data, at + 6)
        packed = struct.unpack_from("<I", data, at + 18)[0]
        n, m = struct.unpack_from("<HH", data, at + 26)
        name = data[at + 30 : at + 30 + n].decode("utf-8", "replace")
        body = at + 30 + n + m
        extra = data[at + 30 + n : body]
        while packed == 0xFFFFFFFF and len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            if tag == 1 and length >= 16:
                packed = struct.unpack_from("<Q", extra, 12)[0]
            extra = extra[4 + length :]
        streamed = flags & 8 and not packed
        machine = zlib.decompressobj(-15) if method == 8 else None
        try:
            raw = data[body:] if streamed else data[body : body + packed]
            got = machine.decompress(raw, most) if machine else raw[:most]
        except zlib.error:
            got = b""
        whole = machine.eof if machine else len(raw) == packed
        found.setdefault(name, (got, bool(whole)))
        if streamed:
            if not machine or not machine.eof:
                break
            at = len(data) - len(machine.unused_data)
            at += 16 if data[at : at + 4] == b"PK\x07\x08" else 12
        else:
            at = body + packed
    name = pick_member(list(found))
    return (*found[name], name) if name else (b"", False, None)


def _tar_member(data: bytes) -> tuple[bytes, bool, str | None]:
    """A member of a tar prefix, by its 512-byte headers."""
    at, found, long_name = 0, {}, None
    for _ in range(MEMBER_HOPS):
        head = data[at : at + 512]
        if len(head) < 512 or not head.strip(b"\0"):
            break
        size = int(head[124:136].strip(b"\0 ") or b"0", 8) if head[124] < 0x80 else int.from_bytes(head[125:136], "big")
        name = long_name or b"/".join(x for x in (head[345:500].split(b"\0")[0] if head[257:262] == b"ustar" else b"", head[:100].split(b"\0")[0]) if x).decode("utf-8", "replace")
        body, kind = data[at + 512 : at + 512 + size], head[156:157]
        long_name = body.split(b"\0")[0].decode("utf-8", "replace") if kind == b"L" else None
        if kind in (b"0", b"\0", b"7") and size:
            found.setdefault(name, (body, len(body) == size))
        at += 512 + (size + 511) // 512 * 512
    name = pick_member(list(found))
    return (*found[name], name) if name else (b"", False, None)


def decompress_one(data: bytes, kind: str, most: int = MOST_OUTPUT) -> dict:
    """The start of what a compressed prefix holds, and whether it is whole."""
    out, whole, member, note, used = b"", False, None, None, len(data)
    if kind == "none":
        out, whole = data[:most], len(data) <= most
    elif kind in ("gzip", "bgzf"):
        out, whole, used = _inflate(data, most)
    elif kind == "tar.gz":
        inner, _, used = _inflate(data, most)
        out, whole, member = _tar_member(inner)
    elif kind == "tar":
        out, whole, member = _tar_member(data)
    elif kind == "zip":
        out, whole, member = _zip_member(data, most)
    elif kind == "bzip2":
        out, whole, used = _stream(bz2.BZ2Decompressor(), data, most)
    elif kind == "xz":
        out, whole, used = _stream(lzma.LZMADecompressor(), data, most)
    elif kind == "zstd":
        import zstandard

        out, whole, used = _stream(zstandard.ZstdDecompressor().decompressobj(), data, most)
    else:
        note = "unsupported_compression"
    if not out and data and note is None:
        note = "truncated_probe"
    return {"data": out, "complete": whole, "member": member, "note": note, "consumed": used}


RESULT = (
    T.StructType().add("data", T.BinaryType()).add("complete", T.BooleanType()).add("member", T.StringType()).add("note", T.StringType()).add("consumed", T.LongType())
)
DECODED = T.StructType().add("text", T.StringType()).add("encoding", T.StringType()).add("confidence", T.DoubleType())


@F.pandas_udf(RESULT)
def decompress_prefix(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """``decompress_one`` over a batch of prefixes."""
    return pd.DataFrame([decompress_one(bytes(d or b""), k) for d, k in zip(content, kind)], columns=["data", "complete", "member", "note", "consumed"])


# --- encodings --------------------------------------------------------------

# Byte-order marks, the longer first.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode_one(data: bytes) -> dict:
    """Text and encoding of bytes whose last character may be cut."""
    for mark, name in MARKS:
        if data.startswith(mark):
            text = codecs.getincrementaldecoder(name)("replace").decode(data)
            return {"text": text.lstrip("﻿"), "encoding": name, "confidence": 1.0}
    if data.isascii():
        return {"text": data.decode("ascii"), "encoding": "ascii", "confidence": 1.0}
    for cut in range(5):
        try:
            return {"text": data[: len(data) - cut].decode("utf-8"), "encoding": "utf-8", "confidence": 0.9}
        except UnicodeDecodeError:
            continue
    if found := guess(data):
        text = codecs.getincrementaldecoder(found[0])("strict").decode(data)  # a character that is cut off goes
        return {"text": text, "encoding": found[0], "confidence": found[1]}
    try:
        return {"text": data.decode("cp1252"), "encoding": "cp1252", "confidence": 0.6}
    except UnicodeDecodeError:
        return {"text": data.decode("latin-1"), "encoding": "latin-1", "confidence": 0.35}


@F.pandas_udf(DECODED)
def decode_text(content: pd.Series) -> pd.DataFrame:
    """``decode_one`` over a batch."""
    return pd.DataFrame([decode_one(bytes(d or b"")) for d in content], columns=["text", "encoding", "confidence"])


@F.pandas_udf(T.StringType())
def parse_yaml(text: pd.Series) -> pd.Series:
    """A sidecar as JSON, for ``from_json``; NULL if it is not YAML."""
    import json

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same rules, by libyaml where it is there

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(yaml.load(x or "", loader), default=str)
        except yaml.YAMLError:
            return None

    return text.map(one)


def format_label(delimiter: Column, compression: Column) -> Column:
    """``TSV.GZIP`` and the like."""
    base = F.when(delimiter == "\t", "TSV").when(delimiter == ",", "CSV").when(delimiter == " ", "SPACE").when(delimiter == ";", "SEMICOLON").when(delimiter == "|", "PIPE").otherwise("UNKNOWN")
    return F.when(compression == "none", base).otherwise(F.concat_ws(".", base, F.upper(compression)))

