"""Categorical naive Bayes over all cells and folds at once.

The model is a table of counts. Training counts of a fold are the cell's counts
minus those of the fold, so the data are read once however many folds there
are. Scores add up over features: any feature set can be scored, and one column
can be swapped, without fitting again. It sees no interactions between
features; ``operators.forest`` is the cross-check for single cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators.profiles import CELL, MISSING, Profiles
from surveyspark.session import BROADCAST_BYTES, BROADCAST_ROWS, Materialized, materialize

ALPHA = 1.0  # additive smoothing
MOST_LOOKUPS = 24  # features looked up by one small join each
SET_BYTES = 16 << 20  # feature sets, once per fold, that are sent to every executor
HELD_NUMBERS, HELD_ROWS = 4 << 20, 4096  # likelihoods that a task holds when it scores sets, and rows scored at once


@dataclass(frozen=True)
class BayesModel:
    """``pool``: cell, feature; features with at least one answer in the cell.
    ``ll``: cell, fold, feature, val, ll (one per class), key, _place, i.

    ``priors``: cell, fold, n_test, prior (per class). ``counts``: cell,
    feature, val, y, fold, n. ``_place`` is one number for (cell, fold), ``key``
    one for (cell, fold, feature, val); both are checked to be unique.
    """

    profiles: Profiles
    counts: Materialized
    ll: Materialized
    priors: Materialized
    pool: Materialized
    salt: int

    def place(self) -> Column:
        """First half of the key, taken once per row before expanding it."""
        return place(self.salt)

    def answer_keys(self) -> Column:
        """The keys of all answers ``x`` of a row with its ``_place``."""
        n = len(self.profiles.features)
        return F.array(*[answer_key("_place", F.lit(i), F.get("x", F.lit(i))) for i in range(n)])


def place(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *[F.col(c) for c in (*CELL, "fold")])


def answer_key(place_col: str, index: Column, val: Column) -> Column:
    return F.xxhash64(place_col, index.cast("int"), val)


def answer_counts(profiles: Profiles) -> DataFrame:
    """Rows per (cell, feature, answer, class, fold); combined before the shuffle."""
    rows = profiles.df.select(*CELL, "y", "fold", "x")
    return profiles.answers(rows).groupBy(*CELL, "feature", "val", "y", "fold").agg(
        F.count(F.lit(1)).alias("n"))


def _by_class_and_fold(p: Profiles) -> list[Column]:
    """Aggregates ``n<class>_<fold>``: rows per class and fold."""
    return [F.expr(f"sum(if(y = {c} and fold = {f}, n, 0)) as n{c}_{f}")
            for c in range(p.n_classes) for f in range(p.n_folds)]


def _training_counts(p: Profiles) -> Column:
    """Per fold, the class counts of all other folds."""
    folds = range(p.n_folds)
    rows = ["array(" + ", ".join(
        " + ".join([f"n{c}_{g}" for g in folds if g != f] or ["0L"]) for c in range(p.n_classes)) + ")" for f in folds]
    return F.expr("array(" + ", ".join(rows) + ")")


def fit(profiles: Profiles) -> BayesModel:
    """All tables here have at most one row per answer option and fold."""
    p = profiles
    counts = materialize(answer_counts(p))
    used = counts.df.where(F.col("y").isNotNull())
    # every respondent answers every feature once (missing included), so any
    # one feature gives the class sizes
    sizes = (used.groupBy(*CELL, "feature", "fold", "y").agg(F.sum("n").alias("n"))
             .groupBy(*CELL, "fold", "y").agg(F.max("n").alias("n")))
    cells = (
        sizes.groupBy(*CELL).agg(F.max("y").alias("_last"), F.sum("n").alias("_all"), *_by_class_and_fold(p))
        .select(*CELL, "_last", "_all", F.posexplode(_training_counts(p)).alias("fold", "_n"))
        .withColumn("n_train", F.slice("_n", F.lit(1), (F.col("_last") + 1).cast("int")))
    )
    total = F.aggregate("n_train", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    priors = materialize(cells.withColumn("_total", total).select(
        *CELL, "fold", (F.col("_all") - F.col("_total")).alias("n_test"), "n_train",
        F.transform("n_train", lambda n: F.ln(
            (n + F.lit(ALPHA)) / (F.col("_total") + F.lit(ALPHA) * F.size("n_train")))).alias("prior")))

    trained = (
        used.groupBy(*CELL, "feature", "val").agg(*_by_class_and_fold(p))
        .select(*CELL, "feature", "val", F.posexplode(_training_counts(p)).alias("fold", "m"))
        .withColumn("in_training", (F.array_max("m") > 0).cast("bigint"))
    )
    options = trained.groupBy(*CELL, "feature", "fold").agg(F.sum("in_training").alias("n_options"))
    likely = (
        trained.join(options, [*CELL, "feature", "fold"])
        .join(priors.df.select(*CELL, "fold", "n_train"), [*CELL, "fold"])
        .withColumn("ll", F.zip_with(F.slice("m", F.lit(1), F.size("n_train")), "n_train", lambda m, n: F.ln(
            (m + F.lit(ALPHA)) / (n + F.lit(ALPHA) * F.col("n_options")))))
        .withColumn("i", F.array_position(F.array(*[F.lit(f) for f in p.features]), F.col("feature")) - 1)
    )
    # not more rows than the counts it is taken from
    pool = Materialized(counts.df.where(F.col("val") != MISSING).select(*CELL, "feature").distinct(), counts.rows)
    # every answer that can be looked up is a row here, so distinct keys are
    # enough for the one-number join to be exact
    for salt in range(8):
        ll = materialize(likely.withColumn("_place", place(salt))
                         .withColumn("key", answer_key("_place", F.col("i"), F.col("val")))
                         .select(*CELL, "fold", "feature", "val", "ll", "key", "_place", F.col("i").cast("int")))
        if ll.df.agg(F.count_distinct("key"), F.count_distinct("_place")).first() == (ll.rows, priors.rows):
            return BayesModel(p, counts, ll, priors, pool, salt)
    raise RuntimeError("no collision-free key found")


def rounded(score: Column) -> Column:
    """Scores are compared at nine decimals, so summation order cannot matter."""
    return F.floor(score * F.lit(1e9) + F.lit(0.5))


def best_class(scores: Column) -> Column:
    """Class with the highest of an array of scores, the later one on a tie."""
    return F.array_max(F.transform(scores, lambda s, c: F.struct(rounded(s).alias("s"), c.alias("c"))))["c"]


def with_best_class(df: DataFrame, scores: list[Column], out: str) -> DataFrame:
    """Add ``out``: the class with the highest score, the later one on a tie.

    Scores of classes a cell does not have are NULL and never win. Plain
    columns throughout, so the step stays inside generated code.
    """
    names = [f"_r{c}" for c in range(len(scores))]
    df = df.withColumns({n: rounded(s) for n, s in zip(names, scores)})
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    df = df.withColumn("_best", best)
    pick = F.lit(None).cast("bigint")
    for c, n in enumerate(names):  # the last class is tested first
        pick = F.when(F.col(n) == F.col("_best"), F.lit(c).cast("bigint")).otherwise(pick)
    return df.withColumn(out, pick).drop("_best", *names)


def test_rows(model: BayesModel) -> DataFrame:
    """Exploded answers of the rows that are scored, with their likelihoods.

    Adds ``i`` (place of the feature), ``ll`` per class and ``key``.
    """
    p = model.profiles
    rows = p.answers(p.by_respondent().withColumn("_place", model.place()))
    rows = rows.withColumn("key", answer_key("_place", F.col("i"), F.col("val"))).drop("_place")
    return model.ll.narrow("key", "ll").join_into(rows, ["key"], spread=p.id_col)


def term_rows(model: BayesModel) -> DataFrame:
    """Scored rows with the likelihoods of their answers: cell, respondent, fold, pos, y, x, _place, lls.

    ``lls`` has one array per feature in their order, NULL at the target's place. Answers are looked up where
    the rows are, one small table per feature, so no row is expanded or moved. With many features, or more answers than
    can be sent to every executor, rows are expanded by feature and summed up by respondent.
    """
    p = model.profiles
    own = [*CELL, p.id_col, "fold", "pos", "y", "x"]
    places = range(len(p.features))
    if len(p.features) <= MOST_LOOKUPS and model.ll.rows <= BROADCAST_ROWS and model.ll.bytes <= BROADCAST_BYTES:
        rows = p.df.where(F.col("y").isNotNull()).select(*own).withColumn("_place", model.place())
        for i in places:
            # the target's own answers have no likelihoods, so nothing is found at its place
            answers = model.ll.df.where(F.col("i") == i).select(F.col("key").alias("_key"), F.col("ll").alias(f"_l{i}"))
            rows = rows.withColumn("_key", answer_key("_place", F.lit(i), F.get("x", F.lit(i)))).join(
                F.broadcast(answers), "_key", "left").drop("_key")
        return rows.select(*own, "_place", F.array(*[f"_l{i}" for i in places]).alias("lls"))
    terms = test_rows(model).groupBy(*CELL, p.id_col, "fold", "pos", "y").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "ll"))).alias("_lls"))
    terms = terms.withColumn("lls", F.transform(F.sequence(F.lit(0), F.lit(len(p.features) - 1)), lambda i: F.try_element_at("_lls", i)))
    at = [*CELL, p.id_col]
    return terms.drop("_lls").join(p.by_respondent().select(*at, "x"), at).withColumn("_place", model.place())


def score_columns(profiles: Profiles) -> list[str]:
    return [f"_s{c}" for c in range(profiles.n_classes)]


def class_scores(model: BayesModel, sets: DataFrame | None = None) -> DataFrame:
    """Held-out score per class, over all features or per feature set.

    ``sets`` is ``(cell, set_id, feature)``. Result: cell, respondent, fold,
    pos, y, [set_id,] and one column per class. The profiles are already
    partitioned by respondent, so the sum over features needs no shuffle of its
    own.
    """
    p = model.profiles
    group = [*CELL, p.id_col, "fold", "pos", "y"]
    if sets is None:
        return with_scores(model, term_rows(model)).select(*group, *score_columns(p))
    group.append("set_id")
    lists = materialize(sets.groupBy(*CELL, "feature").agg(F.collect_list("set_id").alias("set_ids")))
    scored = lists.join_into(test_rows(model), [*CELL, "feature"], spread=p.id_col).withColumn("set_id", F.explode("set_ids"))
    names = score_columns(p)
    sums = scored.groupBy(*group).agg(*[F.sum(F.get("ll", F.lit(c))).alias(n) for c, n in enumerate(names)])
    return model.priors.join_into(sums, [*CELL, "fold"], spread=p.id_col).select(
        *group, *[(F.col(n) + F.get("prior", F.lit(c))).alias(n) for c, n in enumerate(names)])


def with_scores(model: BayesModel, rows: DataFrame) -> DataFrame:
    """Add one column per class to rows with ``lls``: the score over all features. Classes a cell lacks are NULL."""
    p = model.profiles
    total = F.aggregate("lls", F.col("prior"), added)
    rows = model.priors.narrow(*CELL, "fold", "prior").join_into(rows, [*CELL, "fold"], spread=p.id_col)
    # generated, so that the sum is made once and not per class
    rows = rows.withColumn("_scores", F.explode(F.array(total)))
    return rows.withColumns({n: F.get("_scores", F.lit(c)) for c, n in enumerate(score_columns(p))}).drop("_scores", "prior")


def added(scores: Column, ll: Column) -> Column:
    """Scores with one feature's likelihoods added; the target has none."""
    return F.when(ll.isNull(), scores).otherwise(F.zip_with(scores, ll, lambda a, b: a + b))


def predict_sets(model: BayesModel, sets: DataFrame | None = None) -> DataFrame:
    """Held-out class per respondent: cell, respondent, fold, y, [set_id,] pred."""
    names = score_columns(model.profiles)
    scores = class_scores(model, sets)
    return with_best_class(scores, [F.col(n) for n in names], "pred").drop("pos", *names)


def _set_arrays(profiles: Profiles, sets: DataFrame) -> Materialized:
    """Per cell the sets (set_id, places of their features); as many entries as the cell has sets."""
    at = F.array_position(F.array(*[F.lit(f) for f in profiles.features]), F.col("feature")) - 1
    places = sets.select(*CELL, "set_id", at.cast("int").alias("at")).groupBy(*CELL, "set_id").agg(
        F.array_sort(F.collect_list("at")).alias("ats"))
    return materialize(places.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("set_id", "ats"))).alias("sets")))


def _dense(lls: pa.Array, m: int, n_features: int, n_classes: int) -> np.ndarray:
    """Likelihoods as rows × features × classes; 0, which changes no sum, where there are none, and one feature more of that kind."""
    inner = lls.flatten()
    sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy()
    values = inner.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((m, n_features + 1, n_classes))
    out[at // n_features, at % n_features, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _set_hits(places: list[tuple], n_features: int, n_classes: int) -> Callable:
    """Rows (_place, y, lls) to counts (_place, _nth, n_test, n_right) of a task. ``places``: _place, prior, and per set its features' places."""
    places = sorted(places)
    keys = np.array([p[0] for p in places], np.int64)
    most = max(1, HELD_NUMBERS // ((n_features + 1) * n_classes))
    # equal sets of a cell, as many random ones are, are scored once
    different = [list(dict.fromkeys(sets)) for _, _, sets in places]
    priors, ats = [], []
    for (_, start, _), sets in zip(places, different):
        priors.append(np.concatenate((start, np.full(n_classes - len(start), -np.inf))))
        one = np.full((len(sets), max((len(s) for s in sets), default=0)), n_features, np.int64)
        for j, members in enumerate(sets):
            one[j, :len(members)] = [n_features if at < 0 else at for at in members]
        ats.append(one)

    def hits(g: int, y: np.ndarray, lls: np.ndarray) -> np.ndarray:
        """Right rows per set, of rows of one place; ``lls`` by class, feature and row."""
        scores = np.empty((n_classes, len(ats[g]), len(y)))
        scores[:] = priors[g][:, None, None]
        for at in ats[g].T:
            scores += lls[:, at]
        scores = np.floor(scores * 1e9 + 0.5)
        best, top = np.zeros(scores.shape[1:], np.int64), scores[0]
        for c in range(1, n_classes):  # the later one on a tie
            best[scores[c] >= top] = c
            top = np.maximum(top, scores[c])
        return (best == y).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested, right = np.zeros(len(keys), np.int64), [np.zeros(len(d), np.int64) for d in different]

        def count(held: list[pa.RecordBatch]) -> None:
            place = np.concatenate([b.column("_place").to_numpy() for b in held])
            y = np.concatenate([b.column("y").to_numpy() for b in held])
            lls = np.concatenate([_dense(b.column("lls"), b.num_rows, n_features, n_classes) for b in held])
            order = np.argsort(place, kind="stable")
            place, y, lls = place[order], y[order], np.ascontiguousarray(lls[order].transpose(2, 1, 0))
            cuts = np.flatnonzero(np.diff(place, prepend=place[0] - 1)).tolist() + [len(place)]
            for lo, hi in zip(cuts, cuts[1:]):
                g = int(np.searchsorted(keys, place[lo]))
                if g < len(keys) and keys[g] == place[lo]:  # else a cell without sets
                    tested[g] += hi - lo
                    for first in range(lo, hi, HELD_ROWS):
                        part = slice(first, min(hi, first + HELD_ROWS))
                        right[g] += hits(g, y[part], lls[:, :, part])

        held, rows = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                piece = batch.slice(first, most)
                if held and rows + piece.num_rows > most:
                    count(held)
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if held:
            count(held)
        out = []
        for g in np.flatnonzero(tested).tolist():
            nth = {one: j for j, one in enumerate(different[g])}
            out += [(int(keys[g]), i, int(tested[g]), int(right[g][nth[one]])) for i, one in enumerate(places[g][2])]
        for first in range(0, len(out), 10_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[first:first + 10_000]), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                  names=["_place", "_nth", "n_test", "n_right"])
    return run


def set_accuracy(model: BayesModel, sets: DataFrame) -> DataFrame:
    """Held-out accuracy of every feature set: cell, set_id, fold, n_test, n_right, accuracy.

    ``sets`` is ``(cell, set_id, feature)``. A respondent's likelihoods are one array and the cell's sets another, so nothing is
    expanded by set but the hits, which are counted where they arise. Sets up to ``SET_BYTES`` are sent to every
    executor and scored batch by batch, all rows at once; more of them are joined to the rows. Both ways add the same numbers in the same order.
    """
    p = model.profiles
    lists = _set_arrays(p, sets)
    if lists.bytes * p.n_folds <= SET_BYTES:
        # at most SET_BYTES, a row per cell and fold
        known = lists.join_into(model.priors.df, CELL).select(model.place().alias("_place"), "prior", F.col("sets.ats").alias("ats")).collect()
        score = _set_hits([(r._place, tuple(r.prior), [tuple(a) for a in r.ats]) for r in known], len(p.features), p.n_classes)
        hits = term_rows(model).select("_place", F.col("y").cast("bigint").alias("y"), "lls").mapInArrow(
            score, "_place bigint, _nth int, n_test bigint, n_right bigint")
        counts = hits.groupBy("_place", "_nth").agg(F.sum("n_test").alias("n_test"), F.sum("n_right").alias("n_right"))
        folds = model.priors.narrow(*CELL, "fold", model.place().alias("_place"))
        counts = folds.join_into(counts, ["_place"]).drop("_place")
    else:
        rows = model.priors.narrow(*CELL, "fold", "prior").join_into(term_rows(model), [*CELL, "fold"], spread=p.id_col)
        rows = lists.join_into(rows, CELL, spread=p.id_col)
        add = lambda scores, at: added(scores, F.get("lls", at))
        hit = lambda s: (best_class(F.aggregate(s["ats"], F.col("prior"), add)) == F.col("y")).cast("int")
        hits = rows.select(*CELL, "fold", F.posexplode(F.transform("sets", hit)).alias("_nth", "hit"))
        counts = hits.groupBy(*CELL, "fold", "_nth").agg(F.count(F.lit(1)).alias("n_test"), F.sum("hit").alias("n_right"))
    names = lists.df.select(*CELL, F.posexplode("sets").alias("_nth", "s")).select(*CELL, "_nth", "s.set_id")
    return counts.join(names, [*CELL, "_nth"]).drop("_nth").withColumn("accuracy", F.col("n_right") / F.col("n_test"))


def fold_accuracy(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Share of right predictions per held-out fold."""
    return predicted.groupBy(*keys, "fold").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(F.col("pred") == F.col("y")).alias("n_right"),
    ).withColumn("accuracy", F.col("n_right") / F.col("n_test"))
