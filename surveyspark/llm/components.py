"""Connected components of a graph given as edges: local contraction and alternating stars."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.texts import discard, stored

# Edges that one task contracts at a time.
PIECE = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the smallest of them: the larger ones, or the others and itself.

    The smallest neighbour is a partial aggregate and joined back, so a node
    with very many neighbours is not gathered anywhere.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _order(node):
    return tuple(node.values()) if isinstance(node, dict) else node


def contract(pairs: Iterable[tuple]) -> dict:
    """Smallest node of the component of every node of some edges."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, at most ``PIECE`` at a time, as stars around the smallest nodes."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        sides = [pa.concat_arrays([b.column(c) for b in held]) for c in ("a", "b")]
        values = pa.concat_arrays(sides)
        keys = list(map(_order, values.to_pylist()))
        first: dict = {}
        for i, key in enumerate(keys):
            first.setdefault(key, i)
        n = len(keys) // 2
        roots = contract(zip(keys[:n], keys[n:]))
        leaves = [(first[x], first[r]) for x, r in roots.items() if x != r]
        if leaves:
            yield pa.record_batch([values.take(pa.array([p[k] for p in leaves])) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _marked(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """``edges`` written, with their number and a digest that are taken while they are."""
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")), "edges")
    return out, seen.get["n"], seen.get["h"]


def components(edges: DataFrame) -> DataFrame:
    """Root of every node that has an edge: node, root (smallest node of its component).

    ``edges`` holds a, b of any ordered type, null-free as a whole; loops and repeats are
    ignored. Every round first contracts the edges that lie in one task, then hangs all nodes on smaller ones.
    A graph of one piece is done after its first contraction. Each round is written to the shared folder; rounds grow with
    the logarithm of the longest path.
    """
    kind = edges.schema["a"].dataType
    star = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    pieces = lambda df, n: df.repartition(max(1, -(-n // PIECE))).mapInArrow(_contracted, star)
    now, n, seen = _marked(edges.select("a", "b").filter("a <> b").distinct())
    while n:
        one, last, before = n <= PIECE, seen, now
        now, n, seen = _marked(pieces(now, n) if one else _star(_star(pieces(now, n), True), False))
        discard(before)
        if one or last == seen:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
