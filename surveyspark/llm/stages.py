"""Pipeline stages: each takes (spark, docs, sf_dir) and returns documents; the last adds shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyspark.llm import jaccard, mixing, quality, sharding, tiling
from surveyspark.llm.texts import table


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return jaccard.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, repetitions included; those of one document share a shard."""
    return sharding.assign(docs)
