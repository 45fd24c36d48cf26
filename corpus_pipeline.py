"""A training-data pipeline: each stage works on all rows that the one before kept; ``run`` applies them to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import bpe, bytecnn, minhash, mixing, nbsvm
from docsieve.llm.store import Settled, temporaries


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts. It learns from the labelled documents of the table."""
    everything, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return nbsvm.keep_good(docs, everything, labels)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is sure."""
    return bytecnn.keep_identified(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    return bpe.tokenised(docs)


STAGES = [("quality", quality), ("language", language), ("dedup", dedup), ("mixing", mixing_sources), ("encoding", encoding)]

#: Classifiers trained in numpy have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporaries() as mine:
            kept = Settled(stage(spark, docs, sf_dir), name)
            mine.remove(kept)
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
