"""Zip files by their central directory: two bounded ranges, whatever else the archive holds.

The last bytes of a file tell its members and where each of them begins; the member most
likely to be data is picked, and no more than its first bytes are read.  Members are rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.names import DATA_SUFFIXES
from statsift.operators.payload import NOISE
from statsift.sources.kept import keep
from statsift.sources.prefix import PROBE_BYTES, read_ranges

#: Bytes at a file's end that hold its directory, as a rule, and of a directory that is read at most.
TAIL_BYTES, MOST_DIRECTORY = 65_536, 8 << 20
#: Bytes of files, or of what they hold, that a task has in Python at a time, besides the batch they came in.
PIECE_BYTES = 4 << 20
# Fixed values of the format: what its records begin with, and the sizes of those of fixed length.
END, END64, AT64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, AT64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 46, 30
WIDE = 0xFFFFFFFF
MEMBERS = "source_id string, directory_at long, category string, ordinal int, member string, method int, encrypted boolean, packed long, unpacked long, offset long"


def directory_place(tail: bytes, size: int) -> tuple[int, int, int] | None:
    """Where the directory begins, its bytes, and its entries, by the last bytes of a file; None if it has no end record."""
    base, at = size - len(tail), tail.rfind(END)
    while at >= 0:  # a comment may hold the same signature
        if at + END_SIZE <= len(tail):
            n, length, begin, comment = struct.unpack_from("<HIIH", tail, at + 10)
            if at + END_SIZE + comment <= len(tail):
                break
        at = tail.rfind(END, 0, at)
    else:
        return None
    if (n == 0xFFFF or WIDE in (length, begin)) and tail[at - AT64_SIZE : at - AT64_SIZE + 4] == AT64:
        wide = struct.unpack_from("<Q", tail, at - AT64_SIZE + 8)[0] - base
        if 0 <= wide and tail[wide : wide + 4] == END64:
            n, length, begin = struct.unpack_from("<QQQ", tail, wide + 32)
    return begin, length, n


def directory_entries(data: bytes) -> list[tuple]:
    """``member, method, encrypted, packed, unpacked, offset`` of each entry of a directory; a damaged rest is left."""
    out, at = [], 0
    while data[at : at + 4] == ENTRY and at + ENTRY_SIZE <= len(data):
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, unpacked = struct.unpack_from("<II", data, at + 20)
        n, m, k = struct.unpack_from("<HHH", data, at + 28)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + ENTRY_SIZE : at + ENTRY_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = data[at + ENTRY_SIZE + n : at + ENTRY_SIZE + n + m]
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            if tag == 1:  # the wide values, of those that need it, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4) if len(extra) >= 4 + length // 8 * 8 else ())
                unpacked, packed, offset = (next(wide, x) if x == WIDE else x for x in (unpacked, packed, offset))
            extra = extra[4 + length :]
        out.append((name, method, bool(flags & 1), packed, unpacked, offset))
        at += ENTRY_SIZE + n + m + k
    return out


def member_table(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``MEMBERS``."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    named = [x.split() for x in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(named)], [name for name, _ in named])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose ``column`` holds about ``most_bytes``; a larger value stands alone.

    A batch has so many rows whatever they hold, and a part is all that is copied at a time."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def members(tails: DataFrame) -> DataFrame:
    """The member table of zip files: ``source_id, tail, size`` (bytes at the end, size of the file) to ``MEMBERS``.

    A file without an end record is a row with ``no_directory``; one whose directory begins before its
    tail has ``directory_at`` and no members, and goes through ``members_of_directories``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in pieces(batches, "tail"):
            rows = []
            for source, tail, size in zip(*(frame.column(k).to_pylist() for k in ("source_id", "tail", "size"))):
                tail = tail or b""
                place = directory_place(tail, int(size)) if tail else None
                base = int(size) - len(tail) if tail else 0
                if place is None:
                    rows.append((source, None, "no_directory") + (None,) * 7)
                elif place[0] < base:
                    rows.append((source, place[0], None if place[1] <= MOST_DIRECTORY else "directory_too_large") + (None,) * 7)
                else:
                    begin = place[0] - base
                    rows += [(source, place[0], None, i, *e) for i, e in enumerate(directory_entries(tail[begin : begin + place[1]]))]
            yield member_table(rows)

    return tails.select("source_id", "tail", F.col("size").cast("long").alias("size")).filter("size IS NOT NULL").mapInArrow(run, MEMBERS)


def members_of_directories(directories: DataFrame) -> DataFrame:
    """The member table of ``source_id, directory_at, content``, the directories themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "content"):
            known = zip(*(part.column(k).to_pylist() for k in ("source_id", "directory_at", "content")))
            yield member_table([(s, at, None, i, *e) for s, at, data in known for i, e in enumerate(directory_entries(data or b""))])

    return directories.select("source_id", "directory_at", "content").mapInArrow(run, MEMBERS)


def is_noise(name: Column) -> Column:
    """A directory, documentation or a system's own file."""
    low = F.lower(name)
    base = F.regexp_extract(low, "([^/]*)/*$", 1)
    out = F.endswith(low, F.lit("/")) | F.startswith(base, F.lit("._"))
    for part in NOISE:
        out = out | F.contains(low, F.lit(part))
    return out


def pick(table: DataFrame) -> DataFrame:
    """The member of each source that is most likely data: by extension in order of preference, then the first; encrypted ones go last."""
    low = F.regexp_replace(F.lower("member"), "[.]gz$", "")
    rank = F.lit(len(DATA_SUFFIXES))
    for i, suffix in reversed(list(enumerate(DATA_SUFFIXES))):
        rank = F.when(F.endswith(low, F.lit(suffix)), i).otherwise(rank)
    order = Window.partitionBy("source_id").orderBy("encrypted", rank, "ordinal")
    kept = table.filter(F.col("member").isNotNull() & ~is_noise(F.col("member")))
    return kept.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def member_start(data: bytes, most: int) -> tuple[bytes, str | None]:
    """The first ``most`` bytes that a member holds, from the bytes at its offset, and what is wrong with it."""
    if data[:4] != LOCAL or len(data) < LOCAL_SIZE:
        return b"", "decompression_error"
    flags, method = struct.unpack_from("<HH", data, 6)
    n, m = struct.unpack_from("<HH", data, 26)
    body = data[LOCAL_SIZE + n + m :]
    if flags & 1:
        return b"", "encrypted"
    if method not in (0, 8):
        return b"", "unsupported_compression"
    try:
        return (zlib.decompressobj(-15).decompress(body, most) if method == 8 else body[:most]), None
    except zlib.error:
        return b"", "decompression_error"


def member_prefixes(chunks: DataFrame, most: int = PROBE_BYTES) -> DataFrame:
    """``source_id, member, packed, content`` (bytes from a member's offset on) to ``source_id, member, data, category``."""

    def one(data: bytes | None, length: int) -> tuple[bytes, str | None]:
        data = data or b""
        names = sum(struct.unpack_from("<HH", data, 26)) if len(data) >= LOCAL_SIZE else 0
        return member_start(data[: LOCAL_SIZE + names + length], most)  # the next member is not this one's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "content"):
            rows, start, held = [], 0, 0
            for i, (data, length) in enumerate(zip(part.column("content"), part.column("packed").to_pylist())):
                rows.append(one(data.as_py(), length))
                held += len(rows[-1][0])
                if held > PIECE_BYTES or i + 1 == part.num_rows:  # a small member may hold much
                    read = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.binary()), (1, pa.string()))]
                    here = part.slice(start, len(rows))
                    yield pa.RecordBatch.from_arrays([here.column("source_id"), here.column("member"), *read], ["source_id", "member", "data", "category"])
                    rows, start, held = [], i + 1, 0

    kinds = dict(chunks.dtypes)
    return chunks.select("source_id", "member", "content", F.col("packed").cast("long").alias("packed")).mapInArrow(run, f"source_id {kinds['source_id']}, member string, data binary, category string")


def read_zips(files: DataFrame, probe_bytes: int = PROBE_BYTES, tail_bytes: int = TAIL_BYTES, **transfer) -> DataFrame:
    """The data member's first bytes of each zip file: ``source_id, url`` to ``source_id, member, data, category, bytes_received``.

    Two ranges a file: its end, and the member's beginning; a third where the directory is longer than
    ``tail_bytes``.  ``transfer``: the options of ``read_ranges``."""
    none = F.lit(None).cast("long")
    ends = keep(read_ranges(files.select("source_id", "url", none.alias("start"), F.lit(tail_bytes).cast("long").alias("length")), **transfer), "tails")
    known = members(ends.filter("category IS NULL").select("source_id", F.col("content").alias("tail"), "size"))
    known = keep(known, "members")
    longer = known.filter("member IS NULL AND category IS NULL").select("source_id", "directory_at").join(ends.select("source_id", "size"), "source_id").join(files.select("source_id", "url"), "source_id")
    asked = longer.select("source_id", "url", F.col("directory_at").alias("start"), F.least(F.col("size") - F.col("directory_at"), F.lit(MOST_DIRECTORY)).alias("length"))
    more = keep(read_ranges(asked, **transfer), "directories")
    table = known.filter("member IS NOT NULL").unionByName(members_of_directories(more.filter("category IS NULL").select("source_id", F.col("start").alias("directory_at"), "content")))
    chosen = keep(pick(table).join(files.select("source_id", "url"), "source_id"), "chosen")
    # a local header, its names, and what the member's first bytes may take
    wanted = chosen.select("source_id", "url", F.col("offset").alias("start"), (F.least("packed", F.lit(probe_bytes)) + LOCAL_SIZE + 2 * F.octet_length("member") + 1024).cast("long").alias("length"))
    chunks = keep(read_ranges(wanted, **transfer), "chunks")
    read = member_prefixes(chunks.filter("category IS NULL").join(chosen.select("source_id", "member", "packed"), "source_id"), probe_bytes)
    received = ends.select("source_id", "bytes_received").unionByName(more.select("source_id", "bytes_received")).unionByName(chunks.select("source_id", "bytes_received"))
    failed = ends.select("source_id", "category").union(known.select("source_id", "category")).union(more.select("source_id", "category")).union(chunks.select("source_id", "category")).filter("category IS NOT NULL")
    failed = failed.groupBy("source_id").agg(F.first("category").alias("failed"))
    out = files.select("source_id").join(read, "source_id", "left").join(failed, "source_id", "left").join(received.groupBy("source_id").agg(F.sum("bytes_received").alias("bytes_received")), "source_id", "left")
    why = F.coalesce("category", "failed", F.when(F.col("member").isNull(), "no_matching_member"))
    return out.select("source_id", "member", "data", why.alias("category"), "bytes_received")
