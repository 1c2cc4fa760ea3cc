"""Top-k search by rows: repeated ids, extra columns, rows that take no part."""

import numpy as np
from pyspark.sql import functions as F

from surveyspark.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, key string, size int, at string, asked string, rank int"


def brute(rows, k):
    """(query_id, rank, vec_id, score) of every query row against all other rows."""
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows
          if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if b != a and len(c) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best[:k], 1)]
    return sorted(out)


def found(spark, rows, k, parts=3):
    data = [(i, e, "k", 1, "a", "no", 7) for i, e in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in topk.top_k(df, F.expr("vec_id % 20 = 0"), k).collect())


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.5]), (20, [0.25, -1.0]), (1, [1.0, 1.0])]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert len(found(spark, rows, 20)) == 4


def test_all_rows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in rng.integers(0, 200, 400)]
    rows += [(40, rows[0][1])] * 30 + [(7, rows[0][1])] * 30
    rows += [(None, [1.0] * 6), (60, None), (60, []), (60, [1.0, None] * 3), (60, [float("nan")] * 6), (60, [float("inf")] * 6), (60, [1.0])]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, rows, 3) == brute(rows, 3)


def test_no_rows_and_no_queries(spark):
    assert found(spark, [], 20) == [] and found(spark, [(1, [1.0]), (2, [2.0])], 20) == []
