"""Requested features and the survey variables they were mapped to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r3


def selected_features(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Mapped codes per ``keys``, each once, at the rank it first came up."""
    return (mappings.where(F.col("selected_code").isNotNull())
            .groupBy(*keys, "selected_code").agg(F.min("feature_rank").alias("feature_rank")))


def requested_counts(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Requests per ``keys`` and how many different codes they led to."""
    return mappings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k_requested"),
        F.count_distinct("selected_code").alias("k_mapped"))


def coverage(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Asked, unmappable, duplicate and usable requests per ``keys``."""
    counted = mappings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_asked"),
        F.count_if(F.col("selected_code").isNull()).alias("n_unmappable"),
        F.count_distinct("selected_code").alias("n_usable"))
    return counted.select(
        *keys, "n_asked", "n_unmappable",
        (F.col("n_asked") - F.col("n_unmappable") - F.col("n_usable")).alias("n_duplicates_dropped"),
        "n_usable", r3(F.col("n_unmappable") / F.col("n_asked")).alias("unmappable_rate"))


def flag_hits(selected: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``hit``: is the selected code among the cell's top features?

    ``top`` holds ``keys`` and ``feature_variable``.
    """
    marks = top.select(*keys, F.col("feature_variable").alias("selected_code")).distinct() \
        .withColumn("_hit", F.lit(True))
    return (selected.join(marks, [*keys, "selected_code"], "left")
            .withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit"))
