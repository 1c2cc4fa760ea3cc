"""The whole grid as Spark jobs: every target in every country at once."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.operators import bayes, evaluation, importance
from surveyspark.operators.cleaning import clean_survey, question_columns
from surveyspark.operators.profiles import build_profiles
from surveyspark.operators.requests import parse_responses, requested_features, resolve_choices
from surveyspark.operators.resampling import N_DRAWS, N_FOLDS, N_REPEATS, SEED
from surveyspark.operators.similarity import (
    LEAKAGE_SIMILARITY, MIN_SIMILARITY, TOP_K, candidate_lists, nearest_variables)
from surveyspark.session import materialize


@dataclass(frozen=True)
class GridParams:
    """One set of numbers for importance and evaluation, kept with the results."""

    n_folds: int = N_FOLDS
    n_repeats: int | None = N_REPEATS
    n_draws: int = N_DRAWS
    seed: int = SEED


@dataclass(frozen=True)
class GridResult:
    importances: DataFrame
    comparison: DataFrame
    summary: DataFrame
    errors: DataFrame
    params: dict


def run_grid(wide: DataFrame, id_col: str, country_col: str, targets: list[str], admin: list[str],
             mappings: DataFrame, importances: DataFrame | None = None,
             params: GridParams = GridParams()) -> GridResult:
    """Importances, comparison and summary for all cells.

    ``mappings`` holds one row per requested feature: target, country,
    condition, feature_rank, selected_code. ``importances`` replaces the
    computed table when given. Cleaning happens once, before both steps.
    """
    skip = {*admin, id_col, country_col}
    clean = clean_survey(wide, skip)
    profiles = build_profiles(clean, id_col, country_col, targets, question_columns(clean, skip),
                              params.n_folds, params.seed)
    model = bayes.fit(profiles)
    if importances is None:
        importances = materialize(importance.permutation_importance(model, params.n_repeats, params.seed)).df
    comparison = materialize(evaluation.compare(model, mappings, importances, params.n_draws, params.seed)).df
    summary = evaluation.flatten(comparison)
    return GridResult(importances, comparison, summary, evaluation.error_rows(summary), asdict(params))


def map_responses(responses: DataFrame, feature_vectors: DataFrame, variable_vectors: DataFrame,
                  variable_texts: DataFrame, target_vectors: DataFrame, k: int = TOP_K,
                  min_similarity: float = MIN_SIMILARITY,
                  leakage: float | None = LEAKAGE_SIMILARITY, feature_ids: DataFrame | Column | None = None) -> DataFrame:
    """Raw responses to mapping records with candidates, one per requested feature.

    ``responses``: response_id, target, country, raw_response.
    ``feature_vectors``: response_id, feature_rank, label_vector,
    combined_vector. ``target_vectors``: target, target_vector. A feature
    without a vector keeps its record, with no candidates.

    Where features share vectors, ``feature_ids`` (response_id, feature_rank, vector_id) names them and ``feature_vectors`` has
    vector_id in place of the two. Each different (target, vector_id) is matched once, and records move without vectors; vectors that
    several of these share, or neighbouring ids, are compared once. A Column in its place gives the vector_id of a record from its columns.
    """
    listed = requested_features(parse_responses(responses), ["response_id", "target", "country", "condition"])
    records = listed.withColumn("request_id", F.concat_ws(":", "response_id", "feature_rank"))
    if feature_ids is not None:
        records = materialize(records.withColumn("vector_id", feature_ids) if isinstance(feature_ids, Column)
                              else records.join(feature_ids, ["response_id", "feature_rank"], "left")).df
        pairs = records.where(F.col("vector_id").isNotNull()).select("target", "vector_id").distinct()
        pairs = materialize(pairs.withColumn("request_id", F.monotonically_increasing_id())).df
        asked = pairs.join(feature_vectors, "vector_id").join(target_vectors, "target", "left")
        nearest = nearest_variables(asked, variable_vectors, k, min_similarity, leakage, True, "vector_id")
        found = candidate_lists(nearest, pairs, variable_texts).drop("request_id")
        # (target, vector_id) is a row of ``found`` unless the feature has no vector_id
        out = records.join(found.withColumnRenamed("target", "_target"), F.col("target").eqNullSafe(F.col("_target")) & (
            records["vector_id"] == found["vector_id"]), "left").drop(found["vector_id"]).drop("vector_id", "_target")
        return out.withColumn("candidates", F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)))
    requests = records.join(feature_vectors, ["response_id", "feature_rank"]).join(target_vectors, "target", "left")
    nearest = nearest_variables(requests, variable_vectors, k, min_similarity, leakage)
    return candidate_lists(nearest, records, variable_texts)


def choose(records: DataFrame, answers: DataFrame | Column, legacy: bool = False) -> DataFrame:
    """Attach choice answers ``(request_id, raw_choice)`` to mapping records; a Column gives them from a record's columns."""
    if isinstance(answers, Column):
        return resolve_choices(records.withColumn("raw_choice", answers), legacy=legacy)
    return resolve_choices(records.join(answers, "request_id", "left"), legacy=legacy)
