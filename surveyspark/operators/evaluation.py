"""Cross-validated accuracy of feature sets and the three-way comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4
from surveyspark.operators.bayes import BayesModel, set_accuracy
from surveyspark.operators.encoding import majority_baseline
from surveyspark.operators.importance import top_k
from surveyspark.operators.mapping import requested_counts, selected_features
from surveyspark.operators.profiles import CELL
from surveyspark.operators.resampling import N_DRAWS, SEED, random_draws
from surveyspark.session import materialize

# Error texts of result rows.
NO_FEATURES = "no available features"
FEW_CLASSES = "fewer than 2 classes"
NO_MAPPED = "no mapped features"


def cv_summary(accuracy: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return accuracy.groupBy(*keys).agg(
        r4(F.avg("accuracy")).alias("accuracy_mean"),
        r4(F.stddev_pop("accuracy")).alias("accuracy_std"),
        F.sum("n_test").alias("n_samples"))


def available_features(sets: DataFrame, features: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Requested features that exist, each once, at its first position."""
    return (sets.join(features, "feature", "left_semi")
            .groupBy(*keys, "feature").agg(F.min(position).alias(position)))


def evaluate_feature_sets(model: BayesModel, sets: DataFrame) -> DataFrame:
    """One result row per ``(cell, set_id)`` of ``sets``, errors included.

    All sets of all cells are scored in one aggregation over one fitted model.
    """
    asked = sets.groupBy(*CELL, "set_id").agg(F.count("feature").alias("n_features_requested"))
    # every answered row, those of rare classes included
    answered = model.counts.df.groupBy(*CELL, "feature").agg(F.sum("n").alias("n"))
    known = answered.select(*CELL, "feature")
    usable = materialize(sets.select(*CELL, "set_id", "feature").distinct()
                         .join(known, [*CELL, "feature"], "left_semi")).df
    n_usable = usable.groupBy(*CELL, "set_id").agg(F.count(F.lit(1)).alias("n_features"))
    scores = cv_summary(set_accuracy(model, usable), [*CELL, "set_id"]).drop("n_samples")
    base = majority_baseline(model.profiles.classes.df, CELL)
    rows = (asked.join(n_usable, [*CELL, "set_id"], "left")
            .join(scores, [*CELL, "set_id"], "left").join(base, CELL, "left")
            .join(answered.groupBy(*CELL).agg(F.max("n").alias("n_answered")), CELL, "left"))
    error = (F.when(F.col("n_features").isNull(), NO_FEATURES)
             .when(F.coalesce("n_classes", F.lit(0)) < 2, FEW_CLASSES))
    fine = F.col("error").isNull()
    n_samples = F.when(F.col("n_features").isNull(), F.col("n_answered")).otherwise(F.col("n_samples"))
    return rows.withColumn("error", error).select(
        *CELL, "set_id",
        F.when(fine, F.col("accuracy_mean")).alias("accuracy_mean"),
        F.when(fine, F.col("accuracy_std")).alias("accuracy_std"),
        F.when(fine, r4(F.col("majority_baseline"))).alias("majority_baseline"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
        "n_features_requested", F.coalesce(n_samples, F.lit(0)).alias("n_samples"), "error")


def random_baseline(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over the draws that have a score."""
    return results.groupBy(*keys).agg(
        r4(F.avg("accuracy_mean")).alias("random_acc"),
        r4(F.stddev_pop("accuracy_mean")).alias("random_std"),
        F.count("accuracy_mean").alias("n_draws"))


def comparison_sets(requests: DataFrame, importances: DataFrame, pool: DataFrame,
                    n_draws: int = N_DRAWS, seed: int = SEED) -> DataFrame:
    """Oracle, model and random sets of the same size per cell and condition.

    Result: cell, condition, kind, draw, feature, set_id.
    """
    chosen = selected_features(requests, [*CELL, "condition"])
    wanted = chosen.groupBy(*CELL, "condition").agg(F.count(F.lit(1)).alias("k"))
    none = F.lit(None).cast("int")
    model_sets = chosen.select(*CELL, "condition", F.lit("model").alias("kind"), none.alias("draw"),
                               F.col("selected_code").alias("feature"))
    oracle_sets = top_k(importances, wanted).select(
        *CELL, "condition", F.lit("oracle").alias("kind"), none.alias("draw"),
        F.col("feature_variable").alias("feature"))
    random_sets = random_draws(pool, wanted, CELL, n_draws, seed).select(
        *CELL, "condition", F.lit("random").alias("kind"), "draw", "feature")
    return model_sets.unionByName(oracle_sets).unionByName(random_sets).withColumn(
        "set_id", F.concat_ws("|", "kind", F.coalesce(F.col("draw").cast("string"), F.lit("")), "condition"))


def compare(model: BayesModel, requests: DataFrame, importances: DataFrame,
            n_draws: int = N_DRAWS, seed: int = SEED) -> DataFrame:
    """Nested comparison per cell and condition.

    ``importances`` is any table with target_variable, country,
    feature_variable and importance_mean, whoever computed it. ``k_requested``
    counts requests before unmapped ones and duplicates are removed.
    """
    keys = [*CELL, "condition"]
    sets = materialize(comparison_sets(requests, importances, model.pool.df, n_draws, seed)).df
    results = evaluate_feature_sets(model, sets).withColumns({
        "kind": F.split("set_id", r"\|", 3)[0], "condition": F.get(F.split("set_id", r"\|", 3), F.lit(2))})
    results = materialize(results).df
    part = F.struct("accuracy_mean", "accuracy_std", "majority_baseline", "n_features",
                    "n_features_requested", "n_samples", "error")

    def family(kind: str) -> DataFrame:
        return results.where(F.col("kind") == kind).select(*keys, part.alias(kind))

    draws = random_baseline(results.where(F.col("kind") == "random"), keys)
    draws = draws.select(*keys, F.struct(F.col("random_acc").alias("accuracy_mean"),
                                         F.col("random_std").alias("accuracy_std"),
                                         "n_draws").alias("random"))
    return (
        requested_counts(requests, keys)
        .join(family("oracle"), keys, "left").join(family("model"), keys, "left")
        .join(draws, keys, "left")
        .withColumn("error", F.when(F.col("k_mapped") == 0, NO_MAPPED))
    )


def flatten(comparison: DataFrame, country_codes: DataFrame | None = None) -> DataFrame:
    """Nested comparison to flat summary rows; missing parts give NULL.

    ``country_codes`` is (country_name, country_code). A country it doesn't
    know, and any country without it, stands for itself.
    """
    code = F.col("country")
    if country_codes is not None:
        codes = country_codes.groupBy(F.col("country_name").alias("country")).agg(F.max("country_code").alias("_code"))
        comparison, code = comparison.join(codes, "country", "left"), F.coalesce("_code", "country")
    oracle_acc, model_acc, random_acc = (
        F.col(f"{k}.accuracy_mean") for k in ("oracle", "model", "random"))
    return comparison.select(
        *CELL, code.alias("country_code"), "condition", "k_requested", "k_mapped",
        F.col("oracle.majority_baseline").alias("majority_baseline"),
        oracle_acc.alias("oracle_acc"), F.col("oracle.accuracy_std").alias("oracle_std"),
        model_acc.alias("model_acc"), F.col("model.accuracy_std").alias("model_std"),
        random_acc.alias("random_acc"), F.col("random.accuracy_std").alias("random_std"),
        r4(oracle_acc - model_acc).alias("cost_of_imperfect"),
        r4(model_acc - random_acc).alias("value_over_random"),
        F.coalesce("error", "oracle.error", "model.error").alias("error"))


def error_rows(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("error").isNotNull()).select(*CELL, "condition", "error")
