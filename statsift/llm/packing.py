"""Packing: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``width`` tokens where they are
encoded.  Only the histogram of piece lengths, at most ``width`` numbers,
reaches the driver.  There lengths are placed longest first, each into the
shortest pack, the one with the most room, if that takes it, else into a new one;
many equal pieces at a time: a pack is a pattern of lengths with a count.  The
patterns go back to the pieces by rank: the r-th piece of a length takes the r-th
place that the patterns hold for that length.

Defined cases: a null text is an empty one and holds the end id alone; repeated
rows are packed as often as they occur; of packs with equal room any may be taken;
pieces of equal length are ranked by id, start and checksum; a very long text is
cut into as many pieces as it needs, and a task holds that one text and its ids;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm._tokens import encoder

WIDTH = 1024
#: Ranks within a length are counted in so many parts, so that no part holds a large
#: share of all rows; whole pieces, which are most of them, in more.
PARTS, WHOLE_PARTS = 64, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batch: pa.RecordBatch, path: str, width: int, end_id: int) -> pa.Table:
    tool = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    columns: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
    step = 4 * width
    for part in c.slices(batch, "text"):
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), tool.encode(part.column("text").to_pylist())):
            ids += end
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                columns["doc_id"].append(doc_id)
                columns["start"].append(at // 4)
                columns["length"].append(len(piece) // 4)
                columns["ids_crc32"].append(zlib.crc32(piece))
                columns["doc_tokens"].append(len(ids) // 4)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def pack_histogram(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(count, ((length, times), ...))`` that hold every piece once; a length may stand in a pattern more than once.

    ``histogram``: pieces of each length from 1 to ``width``."""
    open_packs: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)  # by room left
    full: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    rooms: set[int] = set()

    def put(count: int, pattern: tuple, room: int) -> None:
        if room == 0:
            full.append((count, pattern))
        else:
            open_packs[room].append((count, pattern))
            rooms.add(room)

    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left = histogram[length]
        while left:
            room = max(rooms, default=0)
            if room < length:
                # new packs; each is the one with the most room until it has as many of this length as it takes
                times = min(left, width // length)
                packs = left // times
                put(packs, ((length, times),), width - length * times)
                left -= packs * times
                continue
            count, pattern = open_packs[room].pop()
            if not open_packs[room]:
                rooms.discard(room)
            packs = min(count, left)
            if count > packs:
                put(count - packs, pattern, room)
            put(packs, (*pattern, (length, 1)), room - length)
            left -= packs
    for packs in open_packs.values():
        full += packs
    return full


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, first sequence, times, offset)`` in order of rank.

    Ranks from ``first rank`` on fill ``times`` places a sequence, from ``offset`` on."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows[length].append((used[length], sequence, times, offset))
            used[length] += count * times
            offset += length * times
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Sequences hold ``width`` tokens at most and are padded at their end.  The
    documents are encoded when this is called; the pieces are a written table."""
    rows = c.pick(docs, doc_id=id_col, text=text_col)
    pieces = c.cut(rows.mapInArrow(c.per_batch(_pieces, remembers=True, path=path, width=width, end_id=end_id), PIECES), "pieces")
    parts = F.when(F.col("length") == width, WHOLE_PARTS).otherwise(PARTS)
    part = F.pmod(F.xxhash64("doc_id", "start"), parts)
    counts = pieces.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    counts = c.cut(counts, "piece-counts")  # at most (width - 1) x PARTS + WHOLE_PARTS rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(pack_histogram(histogram, width))

    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "part", base.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("part", part).withColumn("own", own)
    ranked = ranked.join(F.broadcast(bases), ["length", "part"]).withColumn("rank", F.col("own") - 1 + F.col("base"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, ranks = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                at = table[int(length)]
                row = at[np.searchsorted(at[:, 0], ranks[here], "right") - 1]
                nth = ranks[here] - row[:, 0]
                sequence[here] = row[:, 1] + nth // row[:, 2]
                offset[here] = row[:, 3] + nth % row[:, 2] * length
            yield frame.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kept = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return kept.mapInPandas(place, PIECES + ", sequence_id long, offset long")
