"""Requests out, responses in: grids, parsing, candidate choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.text import (
    COUNTRY_PROVIDED, SYSTEM_TEXT, UNPROMPTED, choice_request, combined_text,
    parse_choice, parse_list_body, request_condition, request_text, strip, strip_fence)
from surveyspark.operators.similarity import TOP_K


def grid_cells(targets: DataFrame, countries: DataFrame, key: str = "survey") -> DataFrame:
    """Every target of a survey with every country of it.

    Countries are folded into one array per survey first (a few hundred names),
    so targets are expanded in place.
    """
    names = countries.groupBy(key).agg(F.collect_set("country").alias("_countries"))
    return (targets.join(names, key)
            .withColumn("country", F.explode("_countries")).drop("_countries"))


def request_grid(targets: DataFrame, countries: DataFrame, key: str = "survey",
                 condition: str = "both") -> DataFrame:
    """Requests to send: each target once without a country, and once per country."""
    parts = []
    if condition in (UNPROMPTED, "both"):
        parts.append(targets.withColumn("country", F.lit(None).cast("string")))
    if condition in (COUNTRY_PROVIDED, "both"):
        parts.append(grid_cells(targets, countries, key))
    if not parts:
        raise ValueError(f"unknown condition {condition!r}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("condition", request_condition(F.col("country")))


def build_requests(grid: DataFrame) -> DataFrame:
    """Add both messages of a request, ``system`` and ``request``, to ``(…, question_text, country)``."""
    return grid.withColumns({"system": F.lit(SYSTEM_TEXT),
                             "request": request_text(F.col("question_text"), F.col("country"))})


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add features, n_features, parse_error and condition to raw responses."""
    return (
        # the stripped text is read twice, so it gets a column of its own
        responses.withColumn("_body", strip(strip_fence(F.col("raw_response"))))
        # generated, not projected: filters and counts of features would repeat the parsing
        .withColumn("features", F.explode(F.array(parse_list_body(F.col("_body"))))).drop("_body")
        .withColumn("n_features", F.when(F.size("features") > 0, F.size("features")))
        .withColumn("parse_error", F.when(F.col("features").isNull(), "not a JSON list of objects"))
        .withColumn("condition", request_condition(F.col("country")))
    )


def requested_features(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per requested feature; its rank is its place in the list."""
    return (
        parsed.where(F.size("features") > 0)
        .select(*keys, F.posexplode("features").alias("feature_rank", "f"))
        .select(*keys, "feature_rank", F.coalesce("f.feature", F.lit("")).alias("feature_label"),
                F.coalesce("f.reasoning", F.lit("")).alias("feature_reasoning"))
        .withColumn("combined_text", combined_text(F.col("feature_label"), F.col("feature_reasoning")))
    )


def choice_requests(mappings: DataFrame) -> DataFrame:
    """Texts asking to pick a candidate, for mappings that have any."""
    return mappings.where(F.size("candidates") > 0).withColumn(
        "request", choice_request(F.col("feature_label"), F.col("feature_reasoning"), F.col("candidates")))


def resolve_choices(mappings: DataFrame, raw: str = "raw_choice", legacy: bool = False) -> DataFrame:
    """Attach the chosen candidate. No candidates, "none" or no match give NULLs."""
    n = F.size("candidates")
    answer = F.when(n == 0, F.lit("no candidates")).otherwise(strip(F.col(raw)))
    index = F.when(n > 0, parse_choice(F.col(raw), n, legacy))
    picked = F.when(F.col("selected_rank").isNotNull(), F.get("candidates", F.col("selected_rank")))
    return (mappings.withColumn("selected_rank", index.cast("int"))
            .withColumn("selected_code", picked["var_code"])
            .withColumn("selected_text", picked["question_text"])
            .withColumn("choice_response", answer))
