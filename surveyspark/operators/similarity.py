"""Vector similarity between requests and survey variables.

A variable index of checked size goes to every executor, and requests are
dealt to tasks by the pairs they stand for. A larger index goes out in chunks of that size,
one pass over the requests for each. All pairs are examined, slice by slice, and only
those that pass the threshold (or the best k) leave the task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4
from surveyspark.session import materialize

INDEX_BYTES = 128 << 20  # variable vectors up to this size are sent to every executor
PRODUCT_CELLS = 4_000_000  # similarities held at once, 32 MB
TASK_CELLS, MOST_TASKS = 50_000_000, 4_000  # similarities of one task, some seconds, and tasks
OUT_ROWS = 65_536  # rows handed on at once
TOP_K = 5
MIN_SIMILARITY = 0.3     # kept from here on (inclusive)
LEAKAGE_SIMILARITY = 0.85  # a variable closer to the target than this is excluded (strict)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; a missing vector is a row of NaN, which is near nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = np.asarray(column.is_valid())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if known.all():
        return flat.reshape(len(column), -1)
    width = len(flat) // max(1, known.sum())
    out = np.full((len(column), width), np.nan)
    out[known] = flat.reshape(known.sum(), width)
    return out


def _highest(a: pa.RecordBatch, columns: list[str], vectors: np.ndarray) -> np.ndarray:
    """Highest similarity of a row's vectors with each column of ``vectors``."""
    parts = [_matrix(a.column(c)) for c in columns]
    parts = [m @ vectors if m.shape[1] == len(vectors) else np.full((len(m), vectors.shape[1]), np.nan) for m in parts]
    return reduce(lambda x, y: np.fmax(x, y, out=x), parts)


def _slices(a: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """Row slices of ``a`` small enough for one product with ``n`` vectors."""
    step = max(1, PRODUCT_CELLS // max(1, n))
    for start in range(0, a.num_rows, step):
        yield a.slice(start, step)


def _shared_slices(a: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """Slices as of ``_slices``, where a row next to others with its vectors needs no products of its own."""
    step = max(1, PRODUCT_CELLS // max(1, n))
    label, combined = ([r.tobytes() for r in _matrix(a.column(c))] for c in ("label_vector", "combined_vector"))
    start, seen = 0, set()
    for i, pair in enumerate(zip(label, combined)):
        if i > start and len(seen) + sum(v not in seen for v in set(pair)) > step:
            yield a.slice(start, i - start)
            start, seen = i, set()
        seen.update(pair)
    if start < a.num_rows:
        yield a.slice(start)


@dataclass(frozen=True)
class Index:
    """Ids in order, and their vectors as the columns of one matrix."""

    ids: pa.Array
    vectors: np.ndarray

    def places(self, code) -> tuple[int, int]:
        """First place of ``code`` among the ids, and the one behind its last."""
        value = lambda x: x.as_py()
        return bisect_left(self.ids, code, key=value), bisect_right(self.ids, code, key=value)


def build_index(right: DataFrame, right_id: str, right_vector: str) -> Index:
    """Collects at most ``INDEX_BYTES`` of vectors and lays them out once for all products."""
    rows = right.select(right_id, right_vector).toArrow()
    rows = rows.take(pc.sort_indices(rows, [(right_id, "ascending")]))
    return Index(rows.column(right_id).combine_chunks(), np.ascontiguousarray(_matrix(rows.column(right_vector)).T))


def _match(left: DataFrame, left_id: str, right: DataFrame, right_id: str, right_vector: str,
           product: Callable[[pa.RecordBatch, Index, dict], pa.RecordBatch], schema: str, near: str | None = None) -> tuple[DataFrame, bool]:
    """``product`` over all of ``left`` × ``right``, and whether each left row met all of ``right`` at once.

    ``right`` is broadcast in chunks of at most ``INDEX_BYTES``, one pass over
    ``left`` for each. The work grows with the product of both sides and the bytes only with their
    sum, so ``left`` is dealt to tasks by the products it stands for. A task
    holds one slice of products and hands its rows on in small batches. Rows with equal or neighbouring values
    of ``near`` stay together, so that a product can share what their vectors have in common. Products of one task share a dict.
    """
    n_right, width = right.agg(F.count(F.lit(1)), F.max(F.size(right_vector))).first()
    chunks = max(1, -(-n_right * (width or 1) * 8 // INDEX_BYTES))
    kept = materialize(left)
    tasks = min(MOST_TASKS, max(1, kept.rows * n_right // TASK_CELLS))
    left = kept.df if tasks == 1 else kept.df.repartition(tasks, left_id)
    if near is not None:
        left = kept.df.repartitionByRange(tasks, near).sortWithinPartitions(near)
    if chunks > 1:
        left, right = materialize(left).df, materialize(right).df
    spark, found, slices = left.sparkSession, [], _slices if near is None else _shared_slices
    for chunk in range(chunks):
        own = right if chunks == 1 else right.where(F.pmod(F.xxhash64(right_id), F.lit(chunks)) == chunk)
        index = spark.sparkContext.broadcast(build_index(own, right_id, right_vector))

        def in_place(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            n, kept = len(index.value.ids), {}
            for batch in batches if n else ():
                for piece in slices(batch, n):
                    got = product(piece, index.value, kept)
                    for start in range(0, got.num_rows, OUT_ROWS):
                        yield got.slice(start, OUT_ROWS)

        found.append(left.mapInArrow(in_place, schema))
    return reduce(DataFrame.unionByName, found), chunks == 1


def _found(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def similar_pairs(left: DataFrame, left_id: str, left_vectors: list[str], right: DataFrame,
                  right_id: str, right_vector: str, threshold: float, strict: bool = False) -> DataFrame:
    """Pairs whose similarity reaches ``threshold`` (exceeds it when strict).

    With several left vectors the highest of their similarities counts.
    """
    def product(a: pa.RecordBatch, index: Index, kept: dict) -> pa.RecordBatch:
        sims = _highest(a, left_vectors, index.vectors)
        i, j = np.nonzero(sims > threshold if strict else sims >= threshold)
        return _found([left_id, right_id, "similarity"], a.column(left_id).take(pa.array(i)), index.ids.take(pa.array(j)), sims[i, j])

    types = dict(left.dtypes) | dict(right.dtypes)
    schema = f"`{left_id}` {types[left_id]}, `{right_id}` {types[right_id]}, similarity double"
    return _match(left.select(left_id, *left_vectors), left_id, right, right_id, right_vector, product, schema)[0]


def excluded_variables(targets: DataFrame, variables: DataFrame,
                       leakage: float | None = LEAKAGE_SIMILARITY) -> DataFrame:
    """Codes no request of a target may be mapped to: ``(target, var_code)``.

    The target itself, and variables too close to its question. Targets without
    a vector, or ``leakage=None``, exclude only themselves.
    """
    own = targets.select("target", F.col("target").alias("var_code")).distinct()
    if leakage is None:
        return own
    known = targets.where(F.col("target_vector").isNotNull())
    leaked = similar_pairs(known, "target", ["target_vector"], variables, "var_code", "vector", leakage, strict=True)
    leaked = leaked.select("target", "var_code").where(~F.col("target").eqNullSafe(F.col("var_code")))
    # pairs of different rows differ unless a name repeats, so the pairs need not be compared with each other
    if not (_unique(known, "target") and _unique(variables, "var_code")):
        leaked = leaked.distinct()
    return own.unionByName(leaked)


def _unique(df: DataFrame, name: str) -> bool:
    return df.groupBy(name).count().where("count > 1").isEmpty()


def nearest_variables(requests: DataFrame, variables: DataFrame, k: int = TOP_K,
                      min_similarity: float = MIN_SIMILARITY,
                      leakage: float | None = LEAKAGE_SIMILARITY,
                      exclude_targets: bool = True, near: str | None = None) -> DataFrame:
    """The k best variables per request: request_id, var_code, similarity, cand_rank.

    ``requests``: request_id, target, label_vector, combined_vector,
    target_vector (NULL when the target has no vector). The higher of the two
    request similarities counts. Excluded variables are dropped before ranking.
    Each chunk of the index yields its own k best; the merge sees k rows per chunk.
    ``near`` names a column by which requests with vectors in common are neighbours:
    each different vector meets the index once for all of them.
    """
    columns = ["request_id", "target", "label_vector", "combined_vector", "target_vector", *([near] if near else [])]

    def closed(target: str | None, vector: np.ndarray, index: Index) -> np.ndarray:
        """Marks the places of the codes that a target may not be mapped to."""
        out = np.zeros(len(index.ids), bool)
        if leakage is not None and len(vector) == len(index.vectors) and not np.isnan(vector).any():
            out |= vector @ index.vectors > leakage
        if exclude_targets and target is not None:
            out[slice(*index.places(target))] = True
        return out

    def product(a: pa.RecordBatch, index: Index, kept: dict) -> pa.RecordBatch:
        width, n = len(index.vectors), len(index.ids)
        # few targets, many requests: what a target closes is found once per task, if all of it fits
        targets = _matrix(a.column("target_vector"))
        names = a.column("target").to_pylist()
        place: dict[bytes, int] = {}
        sides, rows = [], []
        for m in (_matrix(a.column(c)) for c in ("label_vector", "combined_vector")):
            side = np.full(a.num_rows, -1)
            if m.shape[1] == width:
                for r, vector in enumerate(m):
                    key = vector.tobytes()
                    if key not in place:
                        place[key] = len(rows)
                        rows.append(vector)
                    side[r] = place[key]
            sides.append(side.tolist())
        sims = np.stack(rows) @ index.vectors if rows else np.empty((0, n))
        none = np.full(n, np.nan)
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for r, (x, y) in enumerate(zip(*sides)):
            if (x, y) not in best:
                row = np.fmax(sims[x] if x >= 0 else none, sims[y] if y >= 0 else none)
                j = np.flatnonzero(row >= min_similarity)
                # equal at six decimals counts as a tie, broken by code (columns are in code order)
                j = j[np.lexsort((j, -np.floor(row[j] * 1e6 + 0.5)))]
                best[x, y] = j, row[j]
            j, values = best[x, y]
            key = (names[r], targets[r].tobytes())
            if key not in kept:
                if len(kept) * n >= INDEX_BYTES:
                    kept.clear()
                kept[key] = closed(names[r], targets[r], index)
            open_ = np.flatnonzero(~kept[key][j[: 8 * k]])
            if len(open_) < k < len(j):
                open_ = np.flatnonzero(~kept[key][j])
            out.append((j[open_[:k]], values[open_[:k]]))
        sizes = np.array([len(j) for j, _ in out], np.int64)
        i = np.repeat(np.arange(len(out)), sizes)
        j, values = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in ((0, np.int64), (1, float)))
        rank = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return _found(["request_id", "var_code", "similarity", "cand_rank"], a.column("request_id").take(pa.array(i)),
                      index.ids.take(pa.array(j)), values, rank.astype(np.int64))

    id_type = dict(requests.dtypes)["request_id"]
    best, complete = _match(
        requests.select(*columns), "request_id", variables, "var_code", "vector", product, f"request_id {id_type}, var_code string, similarity double, cand_rank bigint", near)
    if not complete:
        order = Window.partitionBy("request_id").orderBy(
            F.floor(F.col("similarity") * 1e6 + F.lit(0.5)).desc(), "var_code")
        best = (best.withColumn("cand_rank", (F.row_number().over(order) - 1).cast("bigint"))
                .where(F.col("cand_rank") < k))
    return best.withColumn("similarity", r4(F.col("similarity")))


def candidate_lists(nearest: DataFrame, requests: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per request with its candidate array and best match.

    Requests without a candidate keep an empty array and NULL best match.
    ``texts`` is ``(var_code, question_text)``.
    """
    lists = (
        nearest.join(texts, "var_code", "left")
        .groupBy("request_id").agg(F.array_sort(F.collect_list(
            F.struct("cand_rank", "var_code", "question_text", "similarity"))).alias("ranked"))
        .select("request_id", F.transform("ranked", lambda c: F.struct(
            c["var_code"].alias("var_code"), c["question_text"].alias("question_text"),
            c["similarity"].alias("similarity"))).alias("candidates"))
    )
    empty = F.array().cast("array<struct<var_code:string,question_text:string,similarity:double>>")
    return (requests.join(lists, "request_id", "left")
            .withColumn("candidates", F.coalesce("candidates", empty))
            .withColumn("top_match_code", F.get("candidates", F.lit(0))["var_code"])
            .withColumn("top_match_score", F.get("candidates", F.lit(0))["similarity"]))
