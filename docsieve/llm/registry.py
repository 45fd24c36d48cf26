"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytecnn, centroids, jumphash, kneserney, linefreq, minhash, mixing, nbsvm, oracles, simhash, tokencount, variants, xent


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.predict(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xent.differences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judge(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


def op12_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jumphash.sharded(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_minhash_dedup, op3_lm_scoring, op4_toxicity, op5_source_mixing, op6_token_counts, op7_simhash, op8_byte_bpe, op9_quality, op10_quality_rules, op11_spelling_variants, op12_jump_sharding, op13_centroid_clusters)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
