import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import similarity as S


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # an exact tie
    return v.astype(np.float32)


def frames(spark, v):
    variables = spark.createDataFrame([(f"V{i:02d}", v[i].tolist()) for i in range(40)], "var_code string, vector array<float>")
    requests = spark.createDataFrame(
        [(i, f"V{i % 5:02d}" if i % 5 < 4 else "gone", v[i].tolist(), v[59 - i].tolist(), v[i % 5].tolist() if i % 5 < 4 else None)
         for i in range(60)],
        "request_id int, target string, label_vector array<float>, combined_vector array<float>, target_vector array<float>")
    return requests, variables


def brute(v, leak, exclude=True, k=5, low=0.3):
    d = v.astype(np.float64)
    out = set()
    for i in range(60):
        target = i % 5 if i % 5 < 4 else None
        found = []
        for j in range(40):
            s = max(d[i] @ d[j], d[59 - i] @ d[j])
            if exclude and j == target:
                continue
            if leak is not None and target is not None and d[target] @ d[j] > leak:
                continue
            if s >= low:
                found.append((-np.floor(s * 1e6 + 0.5), j))
        out |= {(i, f"V{j:02d}", r) for r, (_, j) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block", [0, 7, 4096])
@pytest.mark.parametrize("leak,exclude", [(0.5, True), (None, True), (None, False)])
def test_topk_equals_brute_force(spark, vectors, monkeypatch, block, leak, exclude):
    if block:  # otherwise the index goes out at once
        monkeypatch.setattr(S, "INDEX_BYTES", block * variables_bytes(vectors))
    monkeypatch.setattr(S, "PRODUCT_CELLS", 200)
    requests, variables = frames(spark, vectors)
    out = S.nearest_variables(requests, variables, leakage=leak, exclude_targets=exclude)
    assert {(r["request_id"], r["var_code"], r["cand_rank"]) for r in out.collect()} == brute(vectors, leak, exclude)


def variables_bytes(vectors):
    return vectors.shape[1] * 8


def test_threshold_bounds(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0])], "l string, v array<double>")
    right = spark.createDataFrame([("x", [0.5, 0.0]), ("y", [0.4999, 0.0])], "r string, w array<double>")
    keep = S.similar_pairs(left, "l", ["v"], right, "r", "w", 0.5)
    assert [r["r"] for r in keep.collect()] == ["x"]
    assert S.similar_pairs(left, "l", ["v"], right, "r", "w", 0.5, strict=True).count() == 0


def test_requests_without_candidates_stay(spark, vectors):
    requests, variables = frames(spark, vectors)
    near = S.nearest_variables(requests, variables, min_similarity=0.999)
    texts = variables.select("var_code", F.lower("var_code").alias("question_text"))
    out = S.candidate_lists(near, requests.select("request_id"), texts)
    assert out.count() == 60
    assert out.where(F.size("candidates") == 0).where(F.col("top_match_code").isNotNull()).count() == 0


def test_exclusion_without_vector(spark, vectors):
    _, variables = frames(spark, vectors)
    targets = spark.createDataFrame([("V03", vectors[3].tolist()), ("gone", None)], "target string, target_vector array<float>")
    got = {tuple(r) for r in S.excluded_variables(targets, variables, 0.99).select("target", "var_code").collect()}
    assert got == {("V03", "V03"), ("V03", "V07"), ("gone", "gone")}


def test_work_is_dealt_by_pairs_and_handed_on_in_pieces(spark, vectors, monkeypatch):
    """Few bytes, many pairs: one input partition becomes many tasks, whatever the bytes."""
    monkeypatch.setattr(S, "TASK_CELLS", 200)
    requests, variables = frames(spark, vectors)
    requests = requests.coalesce(1)
    pairs = S.similar_pairs(requests, "request_id", ["label_vector", "combined_vector"], variables, "var_code", "vector", 0.3)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    near = S.nearest_variables(requests, variables, leakage=0.5)
    assert near.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert {(r["request_id"], r["var_code"], r["cand_rank"]) for r in near.collect()} == brute(vectors, 0.5)


def test_exclusion_pairs_are_compared_only_where_names_repeat(spark, vectors):
    _, variables = frames(spark, vectors)
    targets = variables.select(F.col("var_code").alias("target"), F.col("vector").alias("target_vector"))
    once = S.excluded_variables(targets, variables, 0.3)
    assert "Exchange" not in once._jdf.queryExecution().optimizedPlan().toString() and once.count() == once.distinct().count()
    twice = S.excluded_variables(targets.unionByName(targets), variables.unionByName(variables), 0.3)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_rows_without_vector_have_no_pairs(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "l string, v array<double>")
    right = spark.createDataFrame([("x", [0.5, 0.0]), ("y", None)], "r string, w array<double>")
    assert [tuple(r) for r in S.similar_pairs(left, "l", ["v"], right, "r", "w", 0.1).collect()] == [("a", "x", 0.5)]


def test_neighbours_share_products(spark, monkeypatch):
    """Requests with vectors in common get the rows they would get alone, and need no slices of their own."""
    import random
    import pyarrow as pa
    rng = random.Random(5)
    monkeypatch.setattr(S, "TASK_CELLS", 300)
    monkeypatch.setattr(S, "PRODUCT_CELLS", 90)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = [unit([rng.gauss(0, 1) for _ in range(3)]) for _ in range(30)]
    variables = spark.createDataFrame([(f"V{i}", v) for i, v in enumerate(vectors)], "var_code string, vector array<double>")
    rows = [(10 * p + t, p, f"V{t}" if t < 4 else None, vectors[p], vectors[(p + 1) % 30], vectors[t] if t < 3 else None) for p in range(30) for t in range(5)]
    requests = spark.createDataFrame(rows, "request_id long, place long, target string, label_vector array<double>, combined_vector array<double>, "
                                           "target_vector array<double>")
    near = S.nearest_variables(requests, variables, leakage=0.8, near="place").collect()
    want = []
    for r, _, target, a, b, t in rows:
        found = []
        for i, v in enumerate(vectors):
            dot = lambda x: sum(p * q for p, q in zip(x, v))
            s = max(dot(a), dot(b))
            if s >= 0.3 and f"V{i}" != target and not (t and dot(t) > 0.8):
                found.append((-round(s, 6), f"V{i}"))
        want += [(r, code, k) for k, (_, code) in enumerate(sorted(found)[:5])]
    assert sorted((r.request_id, r.var_code, r.cand_rank) for r in near) == sorted(want)
    batch = pa.record_batch([pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows])], names=["label_vector", "combined_vector"])
    # 3 vectors a slice: two places and the one behind them, five targets each
    assert [s.num_rows for s in S._shared_slices(batch, 30)] == [10] * 15
