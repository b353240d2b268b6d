"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import ann, bpe, exact_topk, langid, mixing, oracles, passages, quality, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return exact_topk.exact_top_k(table, table.where("vec_id % 100 = 0"), 10)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return ann.nearest(table, table.where("vec_id % 20 = 0"), 20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), mixing.Target(entropy=0.995))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    named = (
        op1_langid, op2_exact_topk, op3_quality, op4_ann, op5_mixing, op6_passages, op7_warc, op8_bpe, op9_simhash,
        op10_sharding,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain versions."""
    return {
        "op2_exact_topk": oracles.exact_top_k(10, 100),
        "op5_mixing": oracles.mixture(0.995),
        "op7_warc": oracles.captures(),
        "op10_sharding": oracles.shards(),
    }
