"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; each segment has a mean and a deviation. For a query q
and a candidate c, Cauchy-Schwarz per segment of length n gives

    sum n (mean_q mean_c + dev_q dev_c)  >=  q . c,

which is the lower bound n ((mean_q - mean_c)^2 + (dev_q - dev_c)^2) of the
squared distance, written for inner products. Bounds tighten from one segment
to many. Candidates come in blocks: at each level those whose bound is below the
k-th best score known so far go, and the survivors are scored exactly, in whole numbers.

Queries and candidates are packed into blocks of bounded size; every pair of blocks is
one row of a join. A task takes one block of queries past several blocks of candidates,
carries the k best along and returns k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.texts import stored

K = 20
SCALE = 64
BLOCK_BYTES = 1 << 19
# Blocks of candidates in a task, and pairs of vectors scored at once.
PAIRS = 16
PRODUCTS = 50_000
LEVELS = (1, 4, 16)


def quantised(vectors: DataFrame, key: Column, asked: Column) -> DataFrame:
    """vec_id, key, asked and v = floor(64 x) as doubles; vectors that are null, empty or hold a null or non-finite component go."""
    good = (F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return vectors.filter(good & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), key.alias("key"), F.coalesce(asked, F.lit(False)).alias("asked"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Per row the means and deviations of its segments, weighted so that a product of two rows is the bound."""
    parts = []
    for part in np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1])):
        mean = v[:, part].mean(axis=1)
        parts += [np.sqrt(len(part)) * mean, np.sqrt(np.maximum(0.0, ((v[:, part] - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(parts, axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; doubles are exact below 2**53."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0 ** 53:
        return (q @ c.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q], object).reshape(len(q), len(c))


class Best:
    """The k best candidates of each query of a block but those of its own key, smaller ids first on ties."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.keys, self.q, self.k = ids, keys, q, k
        self.stats = {s: segment_statistics(q, s) for s in LEVELS}
        self.floor = np.full(len(q), -np.inf)
        self.query = self.cand = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)

    def see(self, ids: np.ndarray, keys: np.ndarray, c: np.ndarray) -> None:
        """Takes one block of candidates into account."""
        open_ = keys[None, :] != self.keys[:, None]
        if np.isfinite(self.floor).any():
            # Scores are whole numbers, so half a unit covers rounding of the bounds.
            slack = 0.5 + 1e-9 * float(np.abs(self.q).max()) * float(np.abs(c).max()) * c.shape[1]
            for s in LEVELS:
                open_ &= self.stats[s] @ segment_statistics(c, s).T + slack >= self.floor[:, None]
        query, cand = np.nonzero(open_)
        if not len(query):
            return
        if len(query) > open_.size // 8:
            score = exact(self.q, c)
            if score.dtype != object and len(ids) > self.k:
                worst = np.where(open_, score, np.iinfo(np.int64).min)
                query, cand = np.nonzero(open_ & (score >= np.partition(worst, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]))
            score = score[query, cand]
        else:
            parts = [pairwise(self.q[query[i: i + PRODUCTS]], c[cand[i: i + PRODUCTS]]) for i in range(0, len(query), PRODUCTS)]
            score = np.concatenate(parts)
        self._merge(query, ids[cand], score)

    def _merge(self, query: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        query, cand = np.concatenate((self.query, query)), np.concatenate((self.cand, cand))
        score = np.concatenate((self.score, score))
        if score.dtype == object:
            by = np.array(sorted(range(len(score)), key=lambda j: (query[j], -score[j], cand[j])))
        else:
            by = np.lexsort((cand, -score, query))
        query = query[by]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.query, self.cand, self.score = query[keep], cand[by][keep], score[by][keep]
        last = rank[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last].astype(float)


def pairwise(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in whole numbers."""
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0 ** 53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c)], object)


def _search(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(best.keys[best.query]), pa.array(best.ids[best.query]), pa.array(best.cand),
                                    pa.array([int(x) for x in best.score], pa.int64())], names=["key", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, keys, c = row["c"].values.to_numpy(), row["ck"].values.to_numpy(), np.frombuffer(row["cv"].as_buffer(), np.float64)
                here = (row["qa"].as_py(), row["part"].as_py())
                if here != at:
                    if best:
                        yield rows()
                    q = row["q"].values.to_numpy()
                    at, best = here, Best(q, row["qk"].values.to_numpy(), np.frombuffer(row["qv"].as_buffer(), np.float64).reshape(len(q), -1), k)
                best.see(ids, keys, c.reshape(len(ids), -1))
        if best:
            yield rows()
    return run


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of equal length in blocks of about ``BLOCK_BYTES``."""
    held: dict[int, list] = {}

    def block(size: int) -> pa.RecordBatch:
        ids, keys, asked, v = zip(*held.pop(size))
        return pa.record_batch([pa.array([size], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())),
                                pa.array([asked], pa.list_(pa.bool_())), pa.array([np.concatenate(v).tobytes()], pa.binary())],
                               names=["size", "ids", "keys", "asked", "block"])

    for batch in batches:
        for i, key, asked, v in zip(batch.column("vec_id").to_pylist(), batch.column("key").to_pylist(),
                                    batch.column("asked").to_pylist(), batch.column("v")):
            v = v.values.to_numpy()
            held.setdefault(len(v), []).append((i, key, asked, v))
            if len(held[len(v)]) * len(v) * 8 >= BLOCK_BYTES:
                yield block(len(v))
    for size in list(held):
        yield block(size)


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of blocks that are asked about."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, keys, asked = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "keys", "asked"))
            v = np.frombuffer(batch.column("block")[row].as_buffer(), np.float64).reshape(len(ids), -1)[asked]
            yield pa.record_batch([pa.array(ids[asked]), pa.array(keys[asked]), pa.array(asked[asked]),
                                   pa.array(list(v), pa.list_(pa.float64()))], names=["vec_id", "key", "asked", "v"])


VECTORS = "vec_id bigint, key bigint, asked boolean, v array<double>"
BLOCKS = "size int, ids array<bigint>, keys array<bigint>, asked array<boolean>, block binary"


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Tables hold vec_id and embedding; other columns are passed over. ``queries`` is a condition that
    tells which rows of ``vectors`` are queries (null: not): each such row gets k rows of its own, from all
    rows but itself, also where vec_ids repeat. Or it is another table: then vectors of
    the query's vec_id are left out, and queries of one vec_id share their k rows.

    Vectors that are null, empty or hold null or non-finite components, and rows without
    vec_id, take no part; vectors are only compared with vectors of the same length. A repeated vec_id
    gives a row each time; ties go to the smaller vec_id. Fewer vectors give fewer rows, empty tables none.
    """
    def pack(df: DataFrame, name: str) -> DataFrame:
        return stored(df.mapInArrow(_pack, BLOCKS).withColumn("at", F.monotonically_increasing_id()), name)

    if isinstance(queries, DataFrame):
        c = pack(quantised(vectors, F.col("vec_id").cast("long"), F.lit(False)), "candidates")
        q = pack(quantised(queries, F.col("vec_id").cast("long"), F.lit(True)), "queries")
    else:
        # Row numbers hold once they are written; queries are taken from what was written.
        c = pack(quantised(vectors, F.monotonically_increasing_id(), queries), "candidates")
        q = pack(c.filter(F.exists("asked", lambda x: x)).mapInArrow(_unpack, VECTORS), "queries")
    pairs = q.select("size", F.col("at").alias("qa")).join(c.select("size", F.col("at").alias("ca")), "size")
    pairs = pairs.join(q.select(F.col("at").alias("qa"), F.col("ids").alias("q"), F.col("keys").alias("qk"), F.col("block").alias("qv")), "qa").join(
        c.select(F.col("at").alias("ca"), F.col("ids").alias("c"), F.col("keys").alias("ck"), F.col("block").alias("cv")), "ca")
    parts = -(-max(1, c.count()) // PAIRS)
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("ca"), F.lit(parts)))
    dealt = pairs.repartition(max(1, q.count() * parts), "qa", "part").sortWithinPartitions("qa", "part")
    got = dealt.mapInArrow(_search(k), "key bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
