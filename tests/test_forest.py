"""Tree ensembles over all cells."""

import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import forest
from surveyspark.operators.profiles import build_profiles


@pytest.fixture(scope="module")
def survey(spark):
    rows = [(i, land, "yes" if i % 3 else "no", "u" if i % 3 else "v", str(i % 4)) for land in ("a", "b") for i in range(60)]
    return spark.createDataFrame([(i + 100 * (r[1] == "b"), *r[1:]) for i, r in enumerate(rows)],
                                 "id bigint, land string, q string, copy string, noise string")


def test_every_cell_and_fold(survey):
    p = build_profiles(survey, "id", "land", ["q", "copy"], ["copy", "noise", "q"])
    got = forest.forest_grid(p, trees=3, depth=2).collect()
    answered = {(r["target"], r["country"], r["fold"]): r["count"] for r in
                p.df.where(F.col("y").isNotNull()).groupBy("target", "country", "fold").count().collect()}
    assert {(r["target"], r["country"], r["fold"]): r["n_test"] for r in got} == answered
    assert len({(r["target"], r["country"]) for r in got}) == 4 and all(r["accuracy"] == 1.0 for r in got)


def brute_forest(rows, trees, depth, n_folds=5):
    """(n_test, n_right) per fold, from definitions: rows are (id, fold, y, {feature: bin})."""
    first = lambda *parts: md5("|".join(map(str, (42, *parts))).encode()).hexdigest()[:2] < forest.SHARE
    squares = lambda own: sum(n * n for n in Counter(r[2] for r in own).values()) / len(own)

    def grown(own, tree, node, level):
        best = None
        for name in sorted(own[0][3]) if level < depth else ():
            if not first("f", tree, node, name):
                continue
            for cut in sorted({r[3][name] for r in own}):
                left, right = [r for r in own if r[3][name] <= cut], [r for r in own if r[3][name] > cut]
                if min(len(left), len(right)) >= forest.MIN_ROWS:
                    gain = squares(left) + squares(right) - squares(own)
                    if gain > forest.LEAST_GAIN and (best is None or gain > best[0]):
                        best = (gain, name, cut, left, right)
        if best is None:
            counts = Counter(r[2] for r in own)
            return max(counts, key=lambda y: (counts[y], y))
        _, name, cut, left, right = best
        return name, cut, grown(left, tree, node * 2, level + 1), grown(right, tree, node * 2 + 1, level + 1)

    def said(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[3] if bins[tree[0]] > tree[1] else tree[2]
        return tree

    out = {}
    for f in range(n_folds):
        test, train = [r for r in rows if r[1] == f], [r for r in rows if r[1] != f]
        bags = [[r for r in train if first("b", t, r[0])] for t in range(trees)]
        forest_ = [grown(bag, t, 1, 0) for t, bag in enumerate(bags) if bag]
        right = 0
        for r in test:
            votes = Counter(said(tree, r[3]) for tree in forest_)
            right += max(votes, key=lambda y: (votes[y], y)) == r[2]
        out[f] = len(test), right
    return out


def test_equals_trees_grown_one_by_one(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        a, b, c = rng.randrange(4), rng.choice(["9", "10", "2", None]), rng.choice("xyz")
        y = ("no", "yes", "so")[(a > 1) ^ (c == "x")] if rng.random() < 0.8 else rng.choice(["no", "yes", "so"])
        rows.append((i, "AB"[i % 3 == 0], y, str(a), b, c))
    clean = spark.createDataFrame(rows, "id bigint, land string, q string, a string, b string, c string")
    p = build_profiles(clean, "id", "land", ["q"], ["a", "b", "c", "q"])
    got = {(r.country, r.fold): (r.n_test, r.n_right) for r in forest.forest_grid(p, trees=4, depth=3).collect()}
    scored = {r.id: (r.fold, r.y) for r in p.df.where("y IS NOT NULL").collect()}
    order = {"a": ["0", "1", "2", "3"], "b": ["2", "9", "10"], "c": ["x", "y", "z"]}
    for land in "AB":
        own = [(i, *scored[i], {n: order[n].index(v) if v is not None else forest.NONE for n, v in zip("abc", r)}) for i, l, _, *r in rows if l == land and i in scored]
        assert {f: got[land, f] for f in range(5)} == brute_forest(own, 4, 3)


def test_many_answers_share_bins(spark, monkeypatch):
    rows = [(i, "A", "ab"[i % 2], f"w{i:03d}") for i in range(80)]
    p = build_profiles(spark.createDataFrame(rows, "id bigint, land string, q string, word string"), "id", "land", ["q"], ["word"])
    bins = {r.val: r.bin for r in forest.feature_bins(p).df.collect()}
    assert bins == {f"w{i:03d}": i * forest.BINS // 80 for i in range(80)}


def test_rows_lie_in_blocks(survey, monkeypatch):
    p = build_profiles(survey, "id", "land", ["q"], ["copy", "noise", "q"])
    want = sorted(map(tuple, forest.forest_grid(p, trees=2, depth=1).collect()))
    assert forest.packed_blocks(p, 2).count() == 2  # one record per cell
    monkeypatch.setattr(forest, "BLOCK_ANSWERS", 60)
    monkeypatch.setattr(forest, "MOST_LOOKUPS", 0)  # rows expanded by feature
    blocks = forest.packed_blocks(p, 2).collect()
    assert len(blocks) > 2 and sum(len(b.fold) // 2 for b in blocks) == 120
    assert sorted(map(tuple, forest.forest_grid(p, trees=2, depth=1).collect())) == want
