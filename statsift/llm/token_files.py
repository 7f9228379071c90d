"""Token-id files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that hold the vocabulary's largest id.  A file
is a row of blocks of ``BLOCK`` ids, then a footer: document ids, where each
document starts, where each block starts.  So any document is read with one
range read of the blocks that hold it, and unpacked by numpy at once.

Documents are dealt to files by ranges of their ids and encoded where they land,
so the files in order of their part number hold all documents in ascending order.

Defined cases: a null text is an empty one and holds the end id alone; a null id
sorts first; documents that share an id follow one another in an order fixed by
their texts, and may lie in several files; a very long text is held by one task with
its ids, and read back by itself; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm._files import for_reading, whole_file
from statsift.llm._tokens import encoder

MAGIC = b"IDPACK01"
BLOCK = 1 << 16
MOST_TASKS = 20_000


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` gave."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Appends documents to an open file; holds one block of ids at most, and the footer."""

    def __init__(self, out, bits: int) -> None:
        self.out, self.bits, self.waiting, self.held = out, bits, [], 0
        self.doc_ids: list[int | None] = []
        self.starts, self.blocks, self.at, self.n = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.waiting)
            last = len(whole) - len(whole) % BLOCK
            for i in range(0, last, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.waiting, self.held = [whole[last:]], len(whole) - last

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.at += len(data)
        self.out.write(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        known = [d is not None for d in self.doc_ids]
        arrays = [
            np.array([d or 0 for d in self.doc_ids], "<i8"),
            np.array(known, "u1"),
            np.array([*self.starts, self.n], "<i8"),
            np.array([*self.blocks, self.at], "<i8"),
        ]
        head = json.dumps({"bits": self.bits, "block": BLOCK, "docs": len(known), "ids": self.n, "blocks": len(self.blocks)}).encode()
        footer = b"".join(a.tobytes() for a in arrays) + head + struct.pack("<I", len(head))
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to the documents of a file by range reads."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id file")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = file.read_at(length, size - 16 - length)
        n = struct.unpack("<I", footer[-4:])[0]
        self.head = json.loads(footer[-4 - n : -4])
        d, b = self.head["docs"], self.head["blocks"]
        self.doc_ids = np.frombuffer(footer, "<i8", d)
        self.known = np.frombuffer(footer, "u1", d, 8 * d).astype(bool)
        self.starts = np.frombuffer(footer, "<i8", d + 1, 9 * d)
        self.blocks = np.frombuffer(footer, "<i8", b + 1, 17 * d + 8)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end`` - 1 of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        block, bits = self.head["block"], self.head["bits"]
        first, last = start // block, (end - 1) // block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        out = []
        for k in range(first, last + 1):
            n = min(block, self.head["ids"] - k * block)
            at = int(self.blocks[k] - self.blocks[first])
            out.append(unpack(data[at : at + (n * bits + 7) // 8], n, bits))
        return np.concatenate(out)[start - first * block : end - first * block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's ``k``-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, and write the files.

    Returns the written index: ``part, path, n_docs, n_tokens``, one row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, tool = TaskContext.get().partitionId(), encoder(path)
        name = f"part-{part:06d}.ids"
        with whole_file(folder, name) as out:
            writer = Writer(out, width_of(max(tool.vocabulary, end_id + 1)))
            for batch in (b for source in ([first], batches) for b in source):
                for some in c.slices(batch, "text"):
                    for doc_id, ids in zip(some.column("doc_id").to_pylist(), tool.encode(some.column("text").to_pylist())):
                        writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
            writer.close()
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_docs": len(writer.doc_ids), "n_tokens": writer.n}])

    rows = c.pick(docs, doc_id=id_col, text=text_col)
    order = rows.withColumn("mark", F.xxhash64("text"))  # splits the rows of an id that occurs very often
    dealt = order.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    return c.cut(dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-file-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files.

    ``start`` counts the ids of all documents before it, over all files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"]):
                with for_reading(path) as file:
                    r = Reader(file)
                    # block by block: about a million ids at a time, whole documents
                    k, n = 0, len(r.doc_ids)
                    while k < n:
                        upto = max(k + 1, int(np.searchsorted(r.starts, r.starts[k] + (1 << 20), "right")) - 1)
                        upto = min(upto, n)
                        ids = r.ids(int(r.starts[k]), int(r.starts[upto])).astype("<u4")
                        bounds = (r.starts[k : upto + 1] - r.starts[k]).tolist()
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                        doc_ids = pd.array(r.doc_ids[k:upto], dtype="Int64")
                        doc_ids[~r.known[k:upto]] = pd.NA
                        yield pd.DataFrame({"doc_id": doc_ids, "start": base + r.starts[k:upto], "n_tokens": np.diff(r.starts[k : upto + 1]), "ids_crc32": crc})
                        k = upto

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # one row a file
    tasks = min(max(1, index.count()), MOST_TASKS)  # a stated number is not coalesced: a file a task
    return placed.repartitionByRange(tasks, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
