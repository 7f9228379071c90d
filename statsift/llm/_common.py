"""What the operators of this subpackage share: columns, folders, tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset and all
    runs in one process, as in tests, a temporary folder takes its place; on a
    cluster that is a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = known or "file://" + tempfile.mkdtemp(prefix="statsift-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/statsift/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    What comes after no longer depends on the shuffles behind ``df``, so a lost
    executor costs no more than the tasks that it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties the tables that tasks of this process left for later ones.
remembered: list[Callable[[], None]] = []


def forget() -> None:
    """Give back what earlier tasks left in this process.

    A worker goes from one operator to the next, and would hold the tables of one beside the work of the other."""
    if not remembered:
        return
    while remembered:
        remembered.pop()()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def per_batch(function: Callable[..., pa.RecordBatch | pa.Table], remembers: bool = False, **fixed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``function`` to each batch alone.

    ``remembers``: it goes on with what earlier tasks left in its process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        for batch in batches:
            if batch.num_rows:
                out = function(batch, **fixed)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes`` bytes each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names: an operator never sees the others,
    so extra columns and clashing names cannot reach it."""
    return docs.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def utf8(text: str | Column) -> Column:
    """A text's UTF-8 bytes; those of a null text are empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")
