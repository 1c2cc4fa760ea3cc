"""From raw documents to a sharded training corpus: the stages, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyspark.llm import stages
from surveyspark.llm.texts import discard, stored

STAGES = [
    ("quality", stages.rated),
    ("near_copies", stages.deduplicated),
    ("decontamination", stages.decontaminated),
    ("mixing", stages.mixed),
    ("sharding", stages.sharded),
]

# Not expressible: the quality model is fitted, and shards come from xxhash64 draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written, read back by the next, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
