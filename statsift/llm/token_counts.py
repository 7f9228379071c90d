"""Token counts: a digest cache.

Texts are normalised in a way that cannot change their count, digested, and
joined to the counts stored for the same tokenizer version.  Only the distinct
misses are encoded; their counts are appended to the cache.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); repeated
texts share one cache entry; a very long text is encoded by one task, which holds it
and its ids; of stored counts for the same digest, which are equal, any may be taken;
rows keep their ids, repeated ids included; empty
tables give no rows; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm._tokens import encoder

CACHE = "version string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer file: a changed file misses the whole cache."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normalised(text: str, drops_white_space: bool):
    """The text as the cache sees it.

    A tokenizer that drops white space counts the same after runs of ASCII white
    space became one space; for any other the text stays as it is."""
    column = F.coalesce(F.col(text), F.lit(""))
    if not drops_white_space:
        return column
    return F.trim(F.regexp_replace(column, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def _count(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    tool, counts = encoder(path), []
    for part in c.slices(batch, "text"):
        counts += [len(ids) // 4 for ids in tool.encode(part.column("text").to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, digest`` for every row.

    ``cache``: path of the stored counts, made on first use; None: a new one
    below the shared folder.  The misses are encoded when this is called."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    cache = cache or c.new_path(spark, "token-counts")
    rows = c.pick(docs, doc_id=id_col, text=text_col)
    keyed = rows.withColumn("digest", F.unhex(F.sha2(normalised("text", encoder(path).dropping), 256)))

    # one representative row for each distinct digest, found without moving a text
    hold = keyed.select("digest", "doc_id", F.xxhash64("text").alias("pick"))
    firsts = hold.groupBy("digest").agg(F.min(F.struct("doc_id", "pick")).alias("first"))
    try:
        stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).select("digest").distinct()
        firsts = firsts.join(stored, "digest", "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    wanted = firsts.select(F.col("first.doc_id").alias("doc_id"), F.col("first.pick").alias("pick"), F.col("digest").alias("miss"))
    held = rows.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = held.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("pick"))).select(F.col("miss").alias("digest"), "text")
    counted = texts.mapInArrow(c.per_batch(_count, remembers=True, path=path), "digest binary, n_tokens bigint")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a row that occurs twice was encoded twice
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)

    counts = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two jobs may have appended the same
    # as a written table, so that both sides of the join are dealt anew and a text that a third of the rows have can be split
    counts = c.cut(counts, "counts")
    sized = keyed.select("doc_id", "digest", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest")
    )
