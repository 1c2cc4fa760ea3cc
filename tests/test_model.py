"""Model, importance and evaluation against a plain re-computation."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surveyspark import session
from surveyspark.operators import bayes, evaluation, importance
from surveyspark.operators.profiles import CELL, build_profiles
from surveyspark.plans.grid import GridParams, run_grid

FEATURES = ["copy", "flat", "noise", "void"]


@pytest.fixture(scope="module")
def survey(spark):
    rng = random.Random(5)
    data = []
    for i in range(240):
        y = rng.choice(["no", "yes", "yes", "maybe"])
        land = "hot" if i % 3 else "cold"
        data.append((i, land, y, y if rng.random() < 0.9 else None, "same", str(rng.randrange(4)), None))
    data.append((240, "hot", "rare", "rare", "same", "0", None))
    return spark.createDataFrame(data, "id int, land string, q string, copy string, flat string, noise string, void string")


@pytest.fixture(scope="module")
def model(survey):
    return bayes.fit(build_profiles(survey, "id", "land", ["q"], FEATURES))


def brute(model, features):
    """Right predictions and scores computed row by row."""
    p = model.profiles
    data = [r.asDict() for r in p.df.where("y is not null").collect()]
    out = {}
    for r in data:
        train = [t for t in data if t["country"] == r["country"] and t["fold"] != r["fold"]]
        every = [t for t in data if t["country"] == r["country"]]
        labels = sorted({t["y"] for t in every})
        size = Counter(t["y"] for t in train)
        best = None
        for c in labels:
            s = math.log((size[c] + 1) / (len(train) + len(labels)))
            for f in features:
                i = p.features.index(f)
                seen = {t["x"][i] for t in train}
                m = sum(t["x"][i] == r["x"][i] and t["y"] == c for t in train)
                s += math.log((m + 1) / (size[c] + len(seen)))
            best = max(best or (-math.inf, -1), (math.floor(s * 1e9 + 0.5), c))
        out[r["id"]] = best[1]
    return out


def test_predictions_equal_brute_force(model):
    got = {r["id"]: r["pred"] for r in bayes.predict_sets(model).collect()}
    assert got == brute(model, FEATURES)


def test_set_predictions_equal_brute_force(spark, model):
    sets = spark.createDataFrame(
        [("q", c, "two", f) for c in ("hot", "cold") for f in ("noise", "copy")]
        + [("q", c, "empty", "void") for c in ("hot", "cold")],
        "target string, country string, set_id string, feature string")
    got = bayes.predict_sets(model, sets).collect()
    for name, features in (("two", ["noise", "copy"]), ("empty", ["void"])):
        assert {r["id"]: r["pred"] for r in got if r["set_id"] == name} == brute(model, features)


def test_importance_properties(model):
    exact = {(r["country"], r["feature_variable"]): r for r in
             importance.permutation_importance(model, n_repeats=None).collect()}
    assert {f for _, f in exact} == {"copy", "flat", "noise"}  # no answer at all: not in the pool
    for c in ("hot", "cold"):
        assert exact[c, "flat"]["importance_mean"] == 0 and exact[c, "flat"]["importance_std"] == 0
        assert exact[c, "copy"]["importance_mean"] > 0.3
    sampled = {(r["country"], r["feature_variable"]): r["importance_mean"] for r in
               importance.permutation_importance(model, n_repeats=60).collect()}
    assert all(abs(sampled[k] - exact[k]["importance_mean"]) < 0.03 for k in exact)


def test_salted_path_gives_the_same(model, monkeypatch):
    def result(n):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in importance.permutation_importance(model, n).collect())

    want, want_exact = result(2), result(None)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert result(2) == want and result(None) == want_exact


def test_same_set_twice_gives_the_same_row(spark, model):
    sets = spark.createDataFrame([("q", "hot", s, f) for s in ("a", "b") for f in ("copy", "noise", "copy")],
                                 "target string, country string, set_id string, feature string")
    a, b = evaluation.evaluate_feature_sets(model, sets).drop("set_id").collect()
    assert a == b and a["n_features"] == 2 and a["n_features_requested"] == 3


def test_guards(spark, survey):
    few = survey.withColumn("q", F.when(F.col("land") == "cold", "yes").otherwise(F.col("q")))
    tiny = spark.createDataFrame([(i, "tiny", f"v{i}", "a", "a", "a", None) for i in range(900, 903)], few.schema)
    m = bayes.fit(build_profiles(few.unionByName(tiny), "id", "land", ["q"], FEATURES))
    sets = spark.createDataFrame([("q", "cold", "s", "copy"), ("q", "hot", "s", "copy"), ("q", "hot", "gone", "nope"),
                                  ("q", "tiny", "s", "copy"), ("q", "tiny", "gone", "nope")],
                                 "target string, country string, set_id string, feature string")
    got = {(r["country"], r["set_id"]): (r["error"], r["accuracy_mean"] is None, r["n_features"], r["n_samples"]) for r in
           evaluation.evaluate_feature_sets(m, sets).collect()}
    few_classes, none = "fewer than 2 classes", "no available features"
    assert got == {("cold", "s"): (few_classes, True, 1, 80), ("hot", "s"): (None, False, 1, 160),
                   ("hot", "gone"): (none, True, 0, 161),  # counted before rare classes go
                   ("tiny", "s"): (few_classes, True, 1, 0), ("tiny", "gone"): (none, True, 0, 3)}


def test_rare_row_is_not_scored(model):
    rare = model.profiles.df.where("id = 240").first()
    assert rare["y"] is None and rare["fold"] is None
    assert bayes.predict_sets(model).where("id = 240").count() == 0


def test_grid_end_to_end(spark, survey):
    asked = [("q", "hot", "unprompted", 0, "copy"), ("q", "hot", "unprompted", 1, None), ("q", "hot", "unprompted", 2, "copy"),
             ("q", "cold", "unprompted", 0, None), ("q", "cold", "country_provided", 0, "noise")]
    mappings = spark.createDataFrame(asked, "target string, country string, condition string, feature_rank int, selected_code string")
    out = run_grid(survey, "id", "land", ["q"], [], mappings, params=GridParams(n_repeats=2, n_draws=3))
    got = {(r["country"], r["condition"]): r for r in out.summary.collect()}
    hot = got["hot", "unprompted"]
    assert (hot["k_requested"], hot["k_mapped"]) == (3, 1)
    assert hot["oracle_acc"] == hot["model_acc"] and hot["cost_of_imperfect"] == 0
    assert got["cold", "country_provided"]["cost_of_imperfect"] > 0
    none = got["cold", "unprompted"]
    assert none["error"] == "no mapped features" and none["model_acc"] is None and none["k_mapped"] == 0
    assert [tuple(r) for r in out.errors.collect()] == [("q", "cold", "unprompted", "no mapped features")]
    plugged = run_grid(survey, "id", "land", ["q"], [], mappings, importances=out.importances,
                       params=GridParams(n_draws=3))
    assert sorted(map(tuple, plugged.summary.collect()), key=str) == sorted(map(tuple, out.summary.collect()), key=str)


def test_top_k_varies_by_cell(spark):
    imp = spark.createDataFrame([("q", c, f, v) for c in "ab" for f, v in (("x", 0.2), ("y", 0.2), ("z", 0.1))],
                                "target_variable string, country string, feature_variable string, importance_mean double")
    k = spark.createDataFrame([("q", "a", 1), ("q", "b", 9)], "target string, country string, k int")
    got = sorted((r["country"], r["feature_variable"]) for r in importance.top_k(imp, k).collect())
    assert got == [("a", "x"), ("b", "x"), ("b", "y"), ("b", "z")]


def test_cells_are_the_keys():
    assert CELL == ["target", "country"]


def test_conditions_may_hold_the_separator(spark, model):
    asked = [(c, f) for c in ("plain", "a|b", "a|b|model|3", "|") for f in ("copy", "noise")]
    requests = spark.createDataFrame([("q", "hot", c, i, f) for i, (c, f) in enumerate(asked)],
                                     "target string, country string, condition string, feature_rank int, selected_code string")
    imp = spark.createDataFrame([("q", "hot", f, m) for m, f in enumerate(["void", "flat", "noise", "copy"])],
                                "target_variable string, country string, feature_variable string, importance_mean int")
    rows = {r["condition"]: r.asDict(recursive=True) for r in evaluation.compare(model, requests, imp, n_draws=3).collect()}
    assert set(rows) == {c for c, _ in asked}
    for r in rows.values():
        assert r["model"] == r["oracle"] == rows["plain"]["model"] and r["model"]["accuracy_mean"] > 0.8
        assert r["random"]["n_draws"] == 3


def test_set_hits_of_a_batch(monkeypatch):
    """Hits of all sets of a cell, equal ones scored once, against sums by hand; likelihoods may lack, cells may have fewer classes or no sets."""
    import math
    import random
    import pyarrow as pa
    from surveyspark.operators import bayes

    monkeypatch.setattr(bayes, "HELD_NUMBERS", 7 * 4 * 3)
    monkeypatch.setattr(bayes, "HELD_ROWS", 2)
    rng = random.Random(3)
    classes = {-5: 3, 8: 2, 11: 3}
    places = [(p, tuple(rng.random() for _ in range(n)), [(0, 2), (1,), (0, 2), (-1, 0, 1), (2,)][: 5 - p % 2]) for p, n in classes.items()]
    rows = []
    for _ in range(60):
        p = rng.choice([-5, 8, 11, 12])
        n = classes.get(p, 3)
        rows.append((p, rng.randrange(n), [None if rng.random() < 0.2 else [round(rng.random(), 1) for _ in range(n)] for _ in range(3)]))
    want = {}
    for p, y, lls in rows:
        for nth, ats in enumerate(next((s for q, _, s in places if q == p), [])):
            scores = list(next(q[1] for q in places if q[0] == p))
            for at in ats:
                if at >= 0 and lls[at]:
                    scores = [a + b for a, b in zip(scores, lls[at])]
            right = max((math.floor(s * 1e9 + 0.5), c) for c, s in enumerate(scores))[1] == y
            n, r = want.get((p, nth), (0, 0))
            want[p, nth] = n + 1, r + right
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(
        [r[2] for r in rows], pa.list_(pa.list_(pa.float64())))], names=["_place", "y", "lls"])
    out = pa.Table.from_batches(list(bayes._set_hits(places, 3, 3)([batch.slice(0, 25), batch.slice(25)]))).to_pylist()
    assert {(r["_place"], r["_nth"]): (r["n_test"], r["n_right"]) for r in out} == want and len(out) == len(want)


def test_sets_that_are_not_sent_score_the_same(spark, monkeypatch):
    from surveyspark.operators import bayes
    from surveyspark.queries import modelling

    sf = "/root/testdata/sf0.001"
    m, sets = modelling.model(spark, sf), modelling._sets(spark, sf).distinct()
    sent = sorted(map(repr, bayes.set_accuracy(m, sets).select("target", "country", "set_id", "fold", "n_test", "n_right", "accuracy").collect()))
    monkeypatch.setattr(bayes, "SET_BYTES", -1)
    joined = sorted(map(repr, bayes.set_accuracy(m, sets).select("target", "country", "set_id", "fold", "n_test", "n_right", "accuracy").collect()))
    assert sent == joined and sent
