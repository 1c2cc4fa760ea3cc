"""Ranks inside groups that stay parallel when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.session import Materialized, materialize


# Rows one task sorts for one group; larger groups are cut into ranges.
RANGE_ROWS = 1_000_000


def hex_digits_for(largest_group: int | None) -> int:
    """Digest digits needed to cut the largest group into bounded ranges."""
    if largest_group is None:
        return 3
    digits = 0
    while largest_group > RANGE_ROWS * 16 ** digits:
        digits += 1
    return digits


def shuffled_row_number(df: DataFrame, keys: list[str], key: Column, tie: str,
                        out: str = "rn", largest_group: int | None = None) -> DataFrame:
    """Add ``out``: 1-based position inside ``keys`` ordered by ``key``, ``tie``.

    ``key`` is a hex digest, so its first digits cut every group into even
    ranges. Rows are numbered inside (group, range), then shifted by the number
    of rows in the lower ranges. No task ever holds a whole group, and the
    result is the same as one ``row_number()`` over the group, which is what
    runs when ``largest_group``, the counted size, is small enough.
    """
    hex_digits = hex_digits_for(largest_group)
    if hex_digits == 0:
        order = Window.partitionBy(*keys).orderBy(key, tie)
        return df.withColumn(out, F.row_number().over(order).cast("bigint"))
    rows = (df.withColumn("_key", key)
              .withColumn("_range", F.substring("_key", 1, hex_digits)))
    bucket = [*keys, "_range"]
    before = (
        rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
        # one row per range: at most 16**hex_digits per group
        .withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_range")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("_key", tie))
    return (
        rows.withColumn("_inside", inside)
        .join(before, bucket)
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_key", "_range", "_inside", "_before")
    )


def ordered_row_number(values: Materialized, keys: list[str], value: str, out: str = "rn") -> DataFrame:
    """Add ``out``: 1-based place of ``value`` inside ``keys``; values are distinct.

    Small tables use one window per group. Larger ones are range partitioned by
    (keys, value), which cuts a huge group into several ordered partitions;
    rows are numbered inside their partition and shifted by the partitions
    before. The placement is written first, so a lost task cannot change it.
    """
    if values.rows <= RANGE_ROWS:
        order = Window.partitionBy(*keys).orderBy(value)
        return values.df.withColumn(out, F.row_number().over(order).cast("bigint"))
    placed = materialize(values.df.repartitionByRange(*keys, value)
                         .withColumn("_part", F.spark_partition_id())).df
    before = (
        placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        # one row per partition
        .withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value))
    return (placed.withColumn(out, inside).join(before, [*keys, "_part"])
            .withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before"))


def sum_before(values: Materialized, value: str, amount: str, out: str) -> DataFrame:
    """Add ``out``: sum of ``amount`` over all smaller values; values are distinct.

    Like ``ordered_row_number``: one window for small tables, ordered partitions
    shifted by the sums before them for larger ones.
    """
    below = (Window.unboundedPreceding, -1)
    if values.rows <= RANGE_ROWS:
        order = Window.orderBy(value).rowsBetween(*below)
        return values.df.withColumn(out, F.coalesce(F.sum(amount).over(order), F.lit(0)))
    placed = materialize(values.df.repartitionByRange(value).withColumn("_part", F.spark_partition_id())).df
    # one row per partition
    before = placed.groupBy("_part").agg(F.sum(amount).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(*below)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(value).rowsBetween(*below)), F.lit(0))
    return placed.withColumn(out, inside).join(before, "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: rank of ``value`` over all rows, ties share the mean rank."""
    counts = materialize(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")))
    ranks = sum_before(counts, value, "_n", "_below").select(
        F.col(value), (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, value, "left")
