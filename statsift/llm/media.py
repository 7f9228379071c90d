"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey PNG of 64 samples a row.  Each
task writes the distinct payloads of its rows to one tar file in the shared
folder, named by their digests; of a payload that several tasks wrote, the index
names one place.  Rows carry digest, offset and length.  The metadata columns
come from range reads of the first bytes alone; the features from a range read
of the payload, which is checked against its digest.

Defined cases: a null text is an empty one, stored as one row of 64 zero bytes;
equal texts share one entry and so all values; null and repeated ids are kept; a
very long text is held by one task with its picture, of which the header limits the
payload to 2**31 rows of samples; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm._files import for_reading, whole_file

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and header chunk
#: Stored bytes that a task reads back, about; neighbours in a shard go together.
READ_BYTES, MOST_TASKS = 8 << 20, 20_000
READ_BACK = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, bit_depth int, media_path string, media_offset long"
METADATA = "digest string, media_path string, media_offset long, media_bytes long, width int, height int, bit_depth int"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.concatenate((np.zeros((len(samples), 1), np.uint8), samples), axis=1)
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of what ``to_png`` gave; any chunk's wrong checksum is an error."""
    width, height, _ = read_header(media)
    at, packed = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Samples, their mean in thousandths, distinct values, and share of zeros in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = len(payload)
    return f"n={n};mean={int(counts @ np.arange(256)) * 1000 // n};distinct={np.count_nonzero(counts)};zeros={int(counts[0]) * 1000 // n}"


def write_shards(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Store the distinct payloads; returns the written index ``digest, path, offset, length``.

    ``digest`` is the SHA-256 of the text's bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"shard-{TaskContext.get().partitionId():06d}.tar"
        there: set[bytes] = set()
        found: dict[str, list] = {"digest": [], "path": [], "offset": [], "length": []}
        with whole_file(folder, name) as out:
            at = 0
            for batch in (b for source in ([first], batches) for b in source):
                for text in batch.column("text"):
                    data = (text.as_py() or "").encode()
                    key = hashlib.sha256(data)
                    if key.digest() in there:
                        continue
                    there.add(key.digest())
                    media = to_png(padded(data))
                    entry = tarfile.TarInfo(key.hexdigest() + ".png")
                    entry.size = len(media)
                    head = entry.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    for k, v in (("digest", entry.name[:64]), ("path", f"{folder}/{name}"), ("offset", at + len(head)), ("length", len(media))):
                        found[k].append(v)
                    at += len(head) + len(media) + -len(media) % 512
            out.write(bytes(1024))
        yield from pa.table(found).to_batches(10_000)

    rows = c.pick(docs, text=text_col)
    return c.cut(rows.mapInArrow(write, "digest string, path string, offset long, length long"), "media-index")


def _by_place(index: DataFrame, read_bytes: int) -> DataFrame:
    """One place of each payload, neighbours in a shard together: a task a stretch of about ``READ_BYTES`` that are read."""
    one = index.groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("at")).select("digest", "at.*")
    tasks = min(1 + read_bytes // READ_BYTES, MOST_TASKS)  # a stated number is not coalesced by the index's own few bytes
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    return one.repartition(tasks, "path", stretch).sortWithinPartitions("path", "offset")


def _read(index: DataFrame, row: Callable, schema: str, read_bytes: int) -> DataFrame:
    """``row(file, digest, path, offset, length)`` of each distinct payload; a shard is opened once a batch."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, entries in frame.groupby("path", sort=False):
                with for_reading(path) as file:
                    for digest, offset, length in sorted(zip(entries["digest"], entries["offset"], entries["length"]), key=lambda x: x[1]):
                        rows.append(row(file, digest, path, offset, length))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return _by_place(index, read_bytes).mapInPandas(read, schema)


def metadata(index: DataFrame) -> DataFrame:
    """``digest, media_path, media_offset, media_bytes, width, height, bit_depth`` of each distinct payload.

    No more than ``HEADER`` bytes of an entry are read."""

    def row(file, digest: str, path: str, offset: int, length: int) -> tuple:
        return (digest, path, offset, length, *read_header(file.read_at(min(HEADER, length), offset)))

    return _read(index, row, METADATA, HEADER * (index.agg(F.count("*")).first()[0]))


def read_back(index: DataFrame) -> DataFrame:
    """Metadata and features of each distinct payload, read from the tar files."""

    def row(file, digest: str, path: str, offset: int, length: int) -> tuple:
        width, height, depth = read_header(file.read_at(HEADER, offset))
        media = file.read_at(length, offset)
        payload = from_png(media)
        return (
            digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), length,
            hashlib.sha256(media).hexdigest(), features(payload), width, height, depth, path, offset,
        )

    return _read(index, row, READ_BACK, index.agg(F.sum("length")).first()[0] or 0)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", payloads: bool = True) -> DataFrame:
    """Every row with its payload's place, metadata and features.

    The shards are written when this is called.  Without ``payloads`` only headers are read, and the
    columns are those of ``metadata``."""
    folder = folder or c.new_path(docs.sparkSession, "media")
    index = write_shards(docs, folder, text_col)
    media = read_back(index) if payloads else metadata(index)
    data = c.utf8("text")
    rows = c.pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("digest"))
    return rows.join(media, "digest")

