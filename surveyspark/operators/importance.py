"""Permutation importance of every feature in every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4
from surveyspark.operators.bayes import (
    BayesModel, score_columns, term_rows, with_best_class, with_scores)
from surveyspark.operators.encoding import majority_baseline
from surveyspark.operators.profiles import CELL
from surveyspark.operators.resampling import N_REPEATS, SEED, permuted
from surveyspark.session import Materialized, materialize


def scored_rows(model: BayesModel) -> DataFrame:
    """One row per held-out respondent: _place, pos, respondent, target, y, right, keys, lls, scores.

    ``right`` tells whether the prediction over all features is right, ``keys``
    are the lookup keys of the given answers and ``lls`` their likelihoods.
    """
    p = model.profiles
    classes = score_columns(p)
    scores = with_best_class(with_scores(model, term_rows(model)), [F.col(s) for s in classes], "_pred")
    return scores.select("_place", "pos", p.id_col, "target", "y", *classes, (F.col("_pred") == F.col("y")).alias("right"),
                         model.answer_keys().alias("keys"), "lls")


def _swapped(model: BayesModel, old: Column, new: Column) -> list[Column]:
    """Scores with one answer replaced: only one term of the sum changes."""
    return [F.col(s) - F.get(old, F.lit(c)) + F.get(new, F.lit(c))
            for c, s in enumerate(score_columns(model.profiles))]


def _named(model: BayesModel, hits: DataFrame) -> DataFrame:
    places = model.priors.narrow(*CELL, "fold", "n_test", model.place().alias("_place"))
    return places.join_into(hits, ["_place"]).withColumn("feature", model.profiles.feature_name("i")).drop("_place", "i")


def _fold_hits_exact(model: BayesModel) -> DataFrame:
    """Hits before, and mean hits over all permutations, per fold and feature.

    A random permutation puts each answer of the fold on each row equally
    often. So it is enough to count, per possible answer, the rows it would
    leave right, and to weigh that with how often the answer was given. Answers
    with the same likelihoods are one: those that occur in one row of the
    training folds, or in none, as most of a free-text feature do, fall together
    by class, so rows grow with the classes and not with the answers. No row
    moves after scoring.
    """
    p = model.profiles
    kept = ["_place", "pos", "y", "right", *score_columns(p)]
    rows = (
        scored_rows(model).select(*kept, "target", F.posexplode("lls").alias("i", "old_ll"))
        .where(p.feature_name("i") != F.col("target")).drop("target"))
    answers = [*CELL, "fold", "feature", "val"]
    given = model.counts.df.where(F.col("y").isNotNull()).groupBy(*answers).agg(F.sum("n").alias("n_given"))
    merged = (model.ll.df.select(*answers, "_place", "i", "ll").join(given, answers)
              .groupBy("_place", "i", "ll").agg(F.sum("n_given").alias("n_given")))
    options = materialize(merged.groupBy("_place", "i").agg(
        F.collect_list(F.struct("ll", "n_given")).alias("options")))
    swaps = options.join_into(rows, ["_place", "i"], spread="pos").select(
        *kept, "i", "old_ll", F.posexplode("options").alias("_nth", "o"))
    swaps = with_best_class(swaps, _swapped(model, F.col("old_ll"), F.col("o.ll")), "_pred")
    hits = swaps.groupBy("_place", "i").agg(
        F.count_if(F.col("right") & (F.col("_nth") == 0)).alias("hits"),
        # whole numbers, so the sum is exact in any order
        F.sum(F.when(F.col("_pred") == F.col("y"), F.col("o.n_given")).otherwise(0)).alias("pairs"))
    return _named(model, hits)


def _fold_hits_sampled(model: BayesModel, n_repeats: int, seed: int) -> DataFrame:
    """Hits before, and summed over ``n_repeats`` random permutations.

    The rows of a fold are permuted once per repeat and every feature is read
    through that permutation. Scored rows move once, with their answer keys; the
    pairs are expanded by repeat and feature, scored and counted in place.
    """
    p = model.profiles
    at = ["_place", "pos"]
    classes = score_columns(p)
    sizes = model.priors.narrow(model.place().alias("_place"), F.col("n_test").alias("n"))
    pairs = permuted(scored_rows(model).drop("lls"), sizes, ["_place"], p.id_col, "keys", n_repeats, seed)
    swaps = (
        pairs.select(*at, "target", "y", "right", *classes, "keys", F.posexplode("donors").alias("rep", "new_keys"))
        .select(*at, "target", "rep", "y", "right", *classes,
                F.posexplode(F.arrays_zip("keys", "new_keys")).alias("i", "_k"))
        .where(p.feature_name("i") != F.col("target"))
        .select(*at, "rep", "y", "right", *classes, "i",
                F.col("_k.keys").alias("old_key"), F.col("_k.new_keys").alias("new_key"))
    )
    for side in ("old", "new"):
        lookup = model.ll.narrow(F.col("key").alias(f"{side}_key"), F.col("ll").alias(f"{side}_ll"))
        swaps = lookup.join_into(swaps, [f"{side}_key"], spread="pos")
    swaps = with_best_class(swaps, _swapped(model, F.col("old_ll"), F.col("new_ll")), "_pred")
    hits = swaps.groupBy("_place", "i").agg(
        F.count_if((F.col("rep") == 0) & F.col("right")).alias("hits"),
        F.count_if(F.col("_pred") == F.col("y")).alias("pairs"))
    return _named(model, hits)


def permutation_importance(model: BayesModel, n_repeats: int | None = N_REPEATS,
                           seed: int = SEED) -> DataFrame:
    """Drop in held-out accuracy when a feature is shuffled within its fold.

    Result: target_variable, country, feature_variable, importance_mean,
    importance_std (population, over folds), majority_baseline; one row per
    feature of the pool. ``n_repeats=None`` takes the mean over all
    permutations instead of a sample: no row moves per repeat, so this is the
    choice for very large surveys.
    """
    p = model.profiles
    if n_repeats is None:
        hits = _fold_hits_exact(model)
        after = F.col("pairs") / (F.col("n_test") * F.col("n_test"))
    else:
        hits = _fold_hits_sampled(model, n_repeats, seed)
        after = F.col("pairs") / (F.col("n_test") * F.lit(n_repeats))
    # a feature without a single hit has no row in ``hits``: it scores 0 before and after
    sizes = model.priors.narrow(*CELL, "fold").df
    every = model.pool.join_into(sizes, CELL)
    drops = every.join(hits, [*CELL, "fold", "feature"], "left").select(
        *CELL, "feature",
        F.coalesce(F.col("hits") / F.col("n_test") - after, F.lit(0.0)).alias("drop"))
    base = Materialized(majority_baseline(p.classes.df, CELL).select(
        *CELL, r4(F.col("majority_baseline")).alias("majority_baseline")), p.classes.rows)
    means = drops.groupBy(*CELL, "feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    return base.join_into(means, CELL).select(
        F.col("target").alias("target_variable"), "country", F.col("feature").alias("feature_variable"),
        "importance_mean", "importance_std", "majority_baseline")


def importance_rank(importances: DataFrame, by: str = "importance_mean") -> DataFrame:
    """Add ``rank`` inside each cell: highest first, code breaks ties.

    A group is the feature list of one cell.
    """
    order = Window.partitionBy("target_variable", "country").orderBy(
        F.col(by).desc(), "feature_variable")
    return importances.withColumn("rank", F.row_number().over(order).cast("bigint"))


def top_k(importances: DataFrame, k: DataFrame | int) -> DataFrame:
    """The k most important features of each cell.

    ``k`` may be one number, or a table ``(target, country, [condition,] k)``
    when every cell asks for its own.
    """
    ranked = importance_rank(importances)
    if isinstance(k, int):
        return ranked.where(F.col("rank") <= k)
    ranked = ranked.withColumnRenamed("target_variable", "target")
    return ranked.join(k, CELL).where(F.col("rank") <= F.col("k"))


def describe_top(importances: DataFrame, variables: DataFrame, k: int = 5, width: int = 50) -> DataFrame:
    """Top-k with the first characters of the variable's description."""
    texts = variables.select(F.col("var_code").alias("feature_variable"),
                             F.substring("description", 1, width).alias("description"))
    return top_k(importances, k).join(texts, "feature_variable", "left")
