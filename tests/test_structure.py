"""Ceilings, information, agreement and screening against plain Python."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from surveyspark.operators import agreement, bayes, screening, structure
from surveyspark.operators.evaluation import evaluate_feature_sets
from surveyspark.operators.profiles import build_profiles

CELL = ["target", "country"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        y = rng.choice("abc")
        rows.append((i, rng.choice(["P", "Q"]), y, y if rng.random() < 0.6 else "x", rng.choice("mn"), None if rng.random() < 0.2 else rng.choice("uvw")))
    clean = spark.createDataFrame(rows, "id bigint, country string, t string, f1 string, f2 string, f3 string")
    return bayes.fit(build_profiles(clean, "id", "country", ["t"], ["f1", "f2", "f3", "t"]))


def ranking(spark, orders):
    rows = [("t", c, f, float(-i)) for c, order in orders.items() for i, f in enumerate(order)]
    return spark.createDataFrame(rows, "target_variable string, country string, feature_variable string, importance_mean double")


def test_prefixes_score_like_sets_of_their_own(spark, model):
    orders = {"P": ["f2", "f1", "f3"], "Q": ["f3", "f2", "f1"]}
    curve = structure.ceiling_curve(model, ranking(spark, orders)).collect()
    sets = [("t", c, f"{c}{k}", f) for c, order in orders.items() for k in range(1, 4) for f in order[:k]]
    alone = evaluate_feature_sets(model, spark.createDataFrame(sets, "target string, country string, set_id string, feature string")).collect()
    want = {r.set_id: (r.accuracy_mean, r.accuracy_std) for r in alone}
    assert {f"{r.country}{r.k}": (r.accuracy_mean, r.accuracy_std) for r in curve} == want
    assert {(r.country, r.k): r.feature for r in curve} == {(c, i + 1): f for c, order in orders.items() for i, f in enumerate(order)}


def test_k90_is_the_first_prefix_near_the_best(spark):
    curve = spark.createDataFrame([("t", "P", k, a) for k, a in ((1, 0.4499), (2, 0.45), (3, 0.5), (4, 0.48))],
                                  "target string, country string, k bigint, accuracy_mean double")
    classes = spark.createDataFrame([("t", "P", "a", "a", 0, 8), ("t", "P", "b", "b", 1, 8), ("t", "P", "c", "b", 1, 0)],
                                    "target string, country string, answer string, label string, y bigint, n bigint")
    got = structure.complexity(curve, classes).first()
    assert (got.k90, got.ceiling, got.all_features, got.n_features, got.entropy, got.n_classes) == (2, 0.5, 0.48, 4, 1.0, 2)


def test_mutual_information(spark):
    rng = random.Random(1)
    rows = [("f", "same" if y == "a" else "other", y) for y in "aabbb" * 4] + [("g", rng.choice("uvw"), rng.choice("abc")) for _ in range(200)]
    rows += [("h", "one", y) for y in "ab"] + [("i", v, "a") for v in "uv"]
    counts = Counter(rows)
    table = spark.createDataFrame([("t", "P", f, v, "abc".index(y), 0, n) for (f, v, y), n in counts.items()] + [("t", "P", "f", "lost", None, None, 9)],
                                  "target string, country string, feature string, val string, y bigint, fold int, n bigint")
    got = {r.feature: r for r in structure.mutual_information(table).collect()}
    for f in "fghi":
        own = [(v, y) for g, v, y in rows if g == f]
        joint, left, right, n = Counter(own), Counter(v for v, _ in own), Counter(y for _, y in own), len(own)
        information = sum(c / n * math.log(c * n / (left[v] * right[y])) for (v, y), c in joint.items())
        entropy = -sum(c / n * math.log(c / n) for c in right.values())
        assert got[f].n == n and abs(got[f].mutual_information - information) < 1e-6
        assert (got[f].share is None) == (entropy == 0) and (not entropy or abs(got[f].share - information / entropy) < 1e-6)


def average_ranks(values):
    return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]


def pearson(a, b):
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    under = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / under if n and under > 1e-12 else None


def test_country_pairs_with_missing_features(spark):
    rng = random.Random(4)
    values = {c: {f"f{i}": float(rng.randrange(4)) for i in range(8) if c == "A" or rng.random() < 0.7} for c in "ABCD"}
    values["E"] = {f"f{i}": 1.0 for i in range(8)}
    values["F"] = {"z": 1.0}
    rows = [("t", c, f, v) for c, own in values.items() for f, v in own.items()] + [("t", "A", "f9", None)]
    got = structure.country_pairs(spark.createDataFrame(rows, "target_variable string, country string, feature_variable string, importance_mean double"))
    got = {(r.country, r.other): (r.n_features, r.spearman) for r in got.collect()}
    assert set(got) == set(combinations("ABCDEF", 2))
    for (c, o), (n, rho) in got.items():
        shared = sorted(set(values[c]) & set(values[o]))
        want = pearson(*(average_ranks([values[x][f] for f in shared]) for x in (c, o))) if shared else None
        assert n == len(shared) and ((rho is None and want is None) or abs(rho - want) < 2e-6)


def test_captured_importance_without_a_positive_base(spark):
    imp = spark.createDataFrame([("t", c, f, v) for c, own in {"P": (0.4, 0.1, -0.1), "Q": (0.0, -0.2, -0.3)}.items() for f, v in zip("xyz", own)],
                                "target_variable string, country string, feature_variable string, importance_mean double")
    asked = spark.createDataFrame([("t", "P", "c", 1, "z"), ("t", "P", "c", 0, "x"), ("t", "P", "c", 2, "x"), ("t", "P", "c", 3, None), ("t", "P", "d", 0, "w"),
                                   ("t", "Q", "c", 0, "y"), ("t", "R", "c", 0, "x")],
                                  "target string, country string, condition string, feature_rank bigint, selected_code string")
    got = {(r.country, r.condition): tuple(r)[3:] for r in structure.captured_importance(asked, imp).collect()}
    assert got == {("P", "c"): (2, 0, 0.3, 0.5, 0.6), ("P", "d"): (1, 1, 0.0, 0.4, 0.0), ("Q", "c"): (1, 0, -0.2, 0.0, None),
                   ("R", "c"): (1, 1, None, None, None)}


SAID = "item bigint, rater string, code string, kind string"


def kappas(said):
    """Cohen per pair and Fleiss from their definitions."""
    pairs, raters = {}, sorted({r for _, r in said})
    for a, b in combinations(raters, 2):
        both = [(said[i, a], said[i, b]) for i, r in said if r == a and (i, b) in said]
        if both:
            n = len(both)
            same = sum(x == y for x, y in both) / n
            chance = sum(sum(x == c for x, _ in both) * sum(y == c for _, y in both) for c in {x for p in both for x in p}) / n ** 2
            pairs[a, b] = (n, same, None if chance == 1 else (same - chance) / (1 - chance))
    items = {}
    for (i, _), c in said.items():
        items.setdefault(i, []).append(c)
    items = [v for v in items.values() if len(v) > 1]
    observed = sum((sum(k * k for k in Counter(v).values()) - len(v)) / (len(v) * (len(v) - 1)) for v in items) / len(items)
    every = Counter(c for v in items for c in v)
    chance = sum((k / sum(every.values())) ** 2 for k in every.values())
    return pairs, (observed - chance) / (1 - chance)


def test_kappas(spark):
    rng = random.Random(9)
    said = {(i, f"r{r}"): rng.choice(agreement.CODES) if rng.random() < 0.5 else agreement.CODES[i % 5] for i in range(60) for r in range(4) if rng.random() < 0.8}
    rows = [(i, r, c, "k") for (i, r), c in said.items()] + [(1, None, "correct", "k"), (None, "r1", "correct", "k"), (2, "r9", None, "k"), (99, "r0", "correct", "k")]
    said[99, "r0"] = "correct"
    table = spark.createDataFrame(rows, SAID)
    pairs, fleiss = kappas(said)
    got = {(r.rater, r.other): (r.n_items, r.agreement, r.kappa) for r in agreement.cohen_kappa(table).collect()}
    assert set(got) == set(pairs) and all(got[k][0] == n and abs(got[k][1] - s) < 1e-4 and abs(got[k][2] - v) < 1e-4 for k, (n, s, v) in pairs.items())
    assert abs(agreement.fleiss_kappa(table).first().kappa - fleiss) < 1e-4
    assert agreement.fleiss_kappa(table, ["kind"]).first().kappa == agreement.fleiss_kappa(table).first().kappa


def test_kappa_where_chance_agrees_always(spark):
    table = spark.createDataFrame([(i, r, "correct", "k") for i in range(3) for r in ("a", "b")], SAID)
    assert agreement.cohen_kappa(table).first().kappa is None and agreement.fleiss_kappa(table).first().kappa is None
    empty = spark.createDataFrame([], SAID)
    assert agreement.cohen_kappa(empty).count() == 0 and agreement.fleiss_kappa(empty).count() == 0 and agreement.sensitivity(empty).count() == 0


def test_ratings_move_once_in_tasks_of_equal_size(spark, monkeypatch):
    monkeypatch.setattr(agreement, "ROWS_PER_TASK", 10, raising=False)
    rows = [(i, r, agreement.CODES[(i + i // 7 * (r == "a")) % 3], "kl"[i % 2]) for i in range(300) for r in ("a", "b")]
    table = spark.createDataFrame(rows, SAID)
    got = agreement.fleiss_kappa(table, ["kind"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(item" in plan and ", 60)" in plan  # 600 ratings, 10 in a task
    for r in got.collect():
        own = {(i, who): code for i, who, code, kind in rows if kind == r.kind}
        assert r.n_items == 150 and r.n_ratings == 300 and abs(r.kappa - kappas(own)[1]) < 1e-4


def test_region_cells_and_profiles(spark):
    sizes = {"A": 12, "B": 4, "C": 7, "D": 3, "E": 2}
    places = spark.createDataFrame([("A", "N"), ("B", "N"), ("C", "N"), ("D", "S"), ("E", None)], "country string, region string")
    answers = spark.createDataFrame([("t", c) for c, n in sizes.items() for _ in range(n)], "target string, country string")
    got = {r.country: (r.level, r.place, r.n_rows) for r in screening.region_cells(answers, places, 10).collect()}
    assert got == {"A": ("country", "A", 12), "B": ("region", "N", 11), "C": ("region", "N", 11), "D": ("all", "ALL", 5), "E": ("all", "ALL", 5)}
    rows = [(i, c, "ab"[i % 2], "x") for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    clean = spark.createDataFrame(rows, "id bigint, country string, t string, f string")
    p = build_profiles(clean, "id", "country", ["t"], ["f"], cells=screening.region_cells(answers, places, 10))
    assert Counter(r.country for r in p.df.collect()) == {"A": 12, "N": 11, "ALL": 5}


def test_quotas_and_draw(spark):
    rows = [(s, f"{s}{i}", float(i % 3)) for s, n in (("a", 10), ("b", 5), ("c", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "section string, target string, score double")
    assert {r.section: r.quota for r in screening.quotas(table, 8).collect()} == {"a": 5, "b": 3, "c": 0}
    assert sum(r.quota for r in screening.quotas(table, 99).collect()) == 16
    first, again = (sorted(r.target for r in screening.stratified_draw(table, 8).collect()) for _ in range(2))
    assert first == again and len(first) == 8
    assert sorted(r.target for r in screening.stratified_draw(table, 8, seed=1).collect()) != first
    best = screening.stratified_draw(table, 8, "score").collect()
    assert sorted(r.score for r in best if r.section == "a") == [1.0, 1.0, 2.0, 2.0, 2.0]
    assert screening.stratified_draw(table.limit(0), 8).count() == 0


def test_list_classes(spark):
    lists = {"A": ("xy", "xy"), "B": ("xy", "yx"), "C": ("xy", "xz"), "D": ("xy", "zw"), "E": ("xy", ""), "F": ("", "")}
    rows = [("t", c, cond, i, code, "urban life") for c, both in lists.items() for cond, codes in zip((screening.BARE, screening.GIVEN), both) for i, code in enumerate(codes)]
    rows += [("t", "F", screening.GIVEN, 0, None, None), ("u", None, screening.BARE, 0, "x", "age"), ("u", "A", screening.GIVEN, 0, "x", "age")]
    table = spark.createDataFrame(rows, "target string, country string, condition string, feature_rank bigint, selected_code string, feature_label string")
    out = screening.list_taxonomy(table)
    assert {(r.target, r.country): r.list_class for r in out.collect()} == {
        ("t", "A"): "same", ("t", "B"): "reordered", ("t", "C"): "partly changed", ("t", "D"): "disjoint", ("t", "E"): "one empty",
        ("t", "F"): "both empty", ("u", "A"): "same"}
    words = {r.target: r.taxonomy for r in screening.context_taxonomy(table, out).collect()}
    assert words == {"t": "context-aware and rigid", "u": "context-unaware and rigid"}


def test_calibration_without_spread(spark):
    """Every cell asks for equally many features: no correlation, and no division by zero."""
    requests = spark.createDataFrame([("t", c, "bare", code) for c in "PQR" for code in "xy"], "target string, country string, condition string, selected_code string")
    requests = requests.selectExpr("*", "1L as feature_rank")
    cells = spark.createDataFrame([("t", c, k, k / 7, 0.5) for c, k in zip("PQR", (1, 2, 4))],
                                  "target string, country string, k90 bigint, entropy double, ceiling double")
    got = structure.complexity_calibration(requests, cells).collect()
    assert {(r.measure, r.n_cells, r.pearson, r.spearman) for r in got} == {(m, 3, None, None) for m in ("k90", "entropy", "ceiling")}


def test_scores_move_no_rows(spark, model, monkeypatch):
    """Likelihoods are looked up where the rows are; the way for many features gives the same scores."""
    rows = bayes.with_scores(model, bayes.term_rows(model)).drop("x")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "RepartitionByExpression" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(bayes, "MOST_LOOKUPS", 0)
    again = bayes.with_scores(model, bayes.term_rows(model)).drop("x")
    shown = lambda df: {(r.id, r.target): (r.lls, [r[c] and round(r[c], 9) for c in bayes.score_columns(model.profiles)]) for r in df.collect()}
    assert shown(rows) == shown(again) and len(shown(rows)) == 240
