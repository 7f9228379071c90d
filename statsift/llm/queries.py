"""The queries of this subpackage, over the tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statsift.llm import centroids, fim, licenses, media, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, token_files, top_k, transducer
from statsift.llm.oracles import ORACLES


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), length=100)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), width=1024, end_id=0)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statsift.llm._common import new_path

    index = token_files.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), new_path(spark, "token-files"), end_id=1)
    return token_files.read_token_files(index)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64).drop("query_uid")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = fim.restore(fim.transform(_table(spark, sf_dir, "documents"), seed=1))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return rebuilt.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``opN_<name>`` of each operator of this subpackage."""
    return {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_minhash_near_dedup, op4_license_scan, op5_sharding, op6_quality_rules, op7_bpe_transducer, op8_media_columns, op9_token_counts, op10_token_files, op11_centroid_clustering, op12_exact_top_k, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return dict(ORACLES)
