"""Seeded folds, permutations and random feature draws."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions.numbers import seeded_key
from surveyspark.operators.ranking import RANGE_ROWS, shuffled_row_number
from surveyspark.session import Materialized

SEED = 42
N_FOLDS = 5
N_DRAWS = 20
N_REPEATS = 10
# Rows of a task that permutes, and rows handed on at once.
ROWS_PER_TASK, OUT_ROWS = 100_000, 10_000


def assign_folds(rows: DataFrame, cell: list[str], id_col: str,
                 k: int = N_FOLDS, seed: int = SEED, largest_cell: int | None = None) -> DataFrame:
    """Add ``fold`` and ``pos`` (place inside the fold, 0-based).

    Rows of a cell are put in seeded random order and dealt to the folds in
    turn: not stratified, and fold sizes differ by one at most.
    """
    ranked = shuffled_row_number(rows, cell, seeded_key(seed, F.col(id_col)), id_col,
                                 largest_group=largest_cell)
    return (ranked
            .withColumn("fold", ((F.col("rn") - 1) % k).cast("int"))
            .withColumn("pos", F.floor((F.col("rn") - 1) / k))
            .drop("rn"))


def permuted_donors(rows: DataFrame, keys: list[str], id_col: str,
                    repeats: int = N_REPEATS, seed: int = SEED,
                    largest_group: int | None = None) -> DataFrame:
    """One random permutation of the rows of each ``keys`` group per repeat.

    Row at place ``pos`` gets its values from the row whose ``pos`` in the
    result is the same: every row appears once per ``rep``.
    """
    repeated = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = seeded_key(seed, F.col("rep"), F.col(id_col))
    return (shuffled_row_number(repeated, [*keys, "rep"], key, id_col, largest_group=largest_group)
            .withColumn("pos", F.col("rn") - 1).drop("rn"))


def _order(texts: list[bytes], prefix: bytes) -> np.ndarray:
    """Places of the texts in order of the md5 of prefix and text."""
    keys = np.frombuffer(b"".join([md5(prefix + t, usedforsecurity=False).digest() for t in texts]), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.argsort(keys[:, 0])
    first = keys[order, 0]
    return np.lexsort((keys[:, 1], keys[:, 0])) if (first[1:] == first[:-1]).any() else order


def permuted(rows: DataFrame, sizes: Materialized, keys: list[str], id_col: str, value: str, repeats: int = N_REPEATS,
             seed: int = SEED, largest_group: int = RANGE_ROWS) -> DataFrame:
    """Add ``donors``: per repeat the ``value`` that the permutation of ``permuted_donors`` puts into the row's place.

    ``pos`` numbers the rows of a group from 0 without gaps, ``sizes`` (keys, n) counts them. Rows move once, whatever the number of repeats:
    a group is ordered anew per repeat by the task that has it. Groups of more than ``largest_group`` rows go by ``permuted_donors``.
    """
    rows = rows.withColumn("_text", F.concat_ws("|", F.lit(""), F.col(id_col).cast("string")).cast("binary"))
    total, largest = sizes.df.agg(F.sum("n"), F.max("n")).first()
    kept = [c for c in rows.columns if c != "_text"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("donors", T.ArrayType(rows.schema[value].dataType))])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        texts, pos = group["_text"].to_pylist(), group["pos"].to_numpy()
        donors = np.empty((group.num_rows, repeats), np.int32)
        for rep in range(repeats):
            donors[:, rep] = _order(texts, f"{seed}|{rep}".encode())[pos]
        values, group = group[value].combine_chunks(), group.select(kept)
        for start in range(0, len(donors), OUT_ROWS):
            own = donors[start:start + OUT_ROWS]
            ends = pa.array(np.arange(0, own.size + 1, repeats, dtype=np.int32))
            given = pa.ListArray.from_arrays(ends, values.take(pa.array(own.ravel())))
            yield from group.slice(start, OUT_ROWS).append_column("donors", given).combine_chunks().to_batches()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) // ROWS_PER_TASK)
    if (largest or 0) <= largest_group:
        return rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(permute, schema)
    large = sizes.narrow(*keys, (F.col("n") > largest_group).alias("_large"))
    rows = large.join_into(rows, keys, spread=id_col)
    small = rows.where("NOT _large").drop("_large").repartition(tasks, *keys).groupBy(*keys).applyInArrow(permute, schema)
    rows = rows.where("_large").drop("_large", "_text")
    moved = permuted_donors(rows.select(*keys, id_col, value), keys, id_col, repeats, seed, largest)
    at = [*keys, "pos"]
    moved = moved.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", F.col(value).alias("v")))), lambda d: d["v"]).alias("donors"))
    return small.unionByName(rows.join(moved, at).select(*small.columns))


def random_draws(pool: DataFrame, wanted: DataFrame, keys: list[str],
                 n_draws: int = N_DRAWS, seed: int = SEED) -> DataFrame:
    """``min(k, pool size)`` features without replacement, ``n_draws`` times.

    ``pool`` is ``(keys, feature)``, ``wanted`` is ``(keys, condition, k)``.
    Draw i is ordered by the seed plus i. A group is one pool, that is the
    number of survey variables.
    """
    drawn = (
        pool.join(wanted, keys)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
        .withColumn("_key", seeded_key(F.col("draw") + F.lit(seed), F.col("feature")))
    )
    order = Window.partitionBy(*keys, "condition", "draw").orderBy("_key", "feature")
    return (drawn.withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= F.col("k"))
            .select(*keys, "condition", "draw", "feature"))
