"""Vectors as whole numbers, packed, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c

#: Whole components up to this size keep all sums of products of 64 of them within 64 bits.
MOST = 2**27
ROW = "vec_id long, v binary, length2 long"


def packed_rows(batch: pa.RecordBatch, scale: int, dims: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that take part: their places, whole components one after the other, and lengths."""
    column = batch.column("v")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
    ends = np.cumsum(sizes)
    odd = np.concatenate((np.zeros(1, np.int64), np.cumsum(~np.isfinite(x))))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (odd[ends] == odd[ends - sizes])
    if dims is not None:
        good &= sizes == dims
    kept = np.floor(x[np.repeat(good, sizes)])
    if len(kept) and np.abs(kept).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} / {scale}")
    return np.flatnonzero(good), kept.astype("<i4"), sizes[good]


def whole_vectors(vectors: DataFrame, scale: int, dims: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v, length2``: each component x as floor(scale * x), in little-endian 32 bits, and the sum of their squares.

    Vectors that are null, hold null or non-finite components, or have not ``dims``
    components (None: any number) are left out; a component beyond ``MOST`` is a ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat, sizes = packed_rows(batch, scale, dims)
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(4 * sizes).astype(np.int32)))
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            squares = np.concatenate((np.zeros(1, np.int64), np.cumsum(flat.astype(np.int64) ** 2)))[np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(pa.array(at)), "v": packed, "length2": pa.array(np.diff(squares))})

    rows = c.pick(vectors, vec_id=id_col, v=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, ROW)


def matrix(packed: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of 64-bit integers; shorter ones end in zeros."""
    sizes = pc.binary_length(packed).to_numpy() // 4
    flat = np.frombuffer(b"".join(packed.to_pylist()), "<i4").astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(packed), width)
    out = np.zeros((len(packed), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[int, np.ndarray]], kind: str = "long") -> dict[int, np.ndarray]:
    """Arrays of numbers (``long`` or ``double``) by key, added up over all rows: first by task, then by Spark.

    What reaches the driver is an array a key, so keys and lengths must be few and fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, array in per_batch(batch).items():
                    held[key] = held[key] + array if key in held else array
        if held:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(held), pa.int32()), "sums": pa.array([x.tolist() for x in held.values()], pa.list_(arrow))})

    arrow, number = (pa.int64(), np.int64) if kind == "long" else (pa.float64(), np.float64)
    cells = rows.mapInArrow(run, f"key int, sums array<{kind}>").select("key", F.posexplode("sums").alias("place", "x"))
    got: dict[int, dict] = {}
    for r in cells.groupBy("key", "place").agg(F.sum("x").alias("x")).collect():
        got.setdefault(r["key"], {})[r["place"]] = r["x"]
    return {key: np.array([held[i] for i in range(len(held))], number) for key, held in got.items()}
