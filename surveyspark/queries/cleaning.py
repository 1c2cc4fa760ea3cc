"""Row filters, column cleaning, encoding and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4, r6
from surveyspark.operators import bayes, evaluation
from surveyspark.operators.cleaning import (
    clean_survey, country_rows, first_answers, numeric_shares, pool_from_long, to_long, with_target)
from surveyspark.operators.encoding import class_distribution, class_table, label_codes, majority_baseline as baseline
from surveyspark.operators.encoding import target_answers
from surveyspark.operators.mapping import selected_features as selected
from surveyspark.operators.profiles import CELL, build_profiles
from surveyspark.queries import views as V
from surveyspark.queries.catalog import FLAT, nested_comparison
from surveyspark.queries.model_views import (
    CLEAN, LONG, TEXT_COLUMNS, answers_view, bayes_views, class_views, num, share)
from surveyspark.queries.modelling import BOOK, _set_views
from surveyspark.queries.views import s4, s6, with_views

TARGETS = ["q_priority", "q_status", "q_segment", "q_balance", "q_priority_code"]


def clean(spark, sf):
    return clean_survey(V.survey_wide(spark, sf), V.SURVEY_ADMIN)


def long(spark, sf):
    return to_long(clean(spark, sf), ["respondent_id", "country"], V.SURVEY_FEATURES)


def country_filter(spark, sf):
    return country_rows(V.survey_wide(spark, sf), "country", "NATION_7").select(
        "respondent_id", "country", "q_status")


def valid_target(spark, sf):
    return with_target(clean(spark, sf), "q_balance").select("respondent_id", "country", "q_balance")


def clean_numeric(spark, sf):
    return clean(spark, sf).select("respondent_id", "q_balance", "q_price", "q_month")


def clean_text(spark, sf):
    return clean(spark, sf).select("respondent_id", "q_priority_code", "q_mixed", "q_status")


def numeric_share(spark, sf):
    cols = ["q_priority_code", "q_mixed", "q_status"]
    return numeric_shares(V.survey_wide(spark, sf), cols).select(*[r6(F.col(c)).alias(c) for c in cols])


def _admin(spark):
    return spark.createDataFrame([(c,) for c in V.SURVEY_ADMIN], "var_code string")


def drop_all_missing(spark, sf):
    return pool_from_long(long(spark, sf), _admin(spark).limit(0), ["country"], "")


def feature_pool(spark, sf):
    return pool_from_long(long(spark, sf), _admin(spark), ["country"], "q_status")


def dedupe_vars(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("event_type").alias("var_code"),
                                            F.col("props").alias("val"), "event_id")
    return first_answers(e, ["user_id"], "event_id")


def label_encode(spark, sf):
    text = to_long(clean(spark, sf), ["respondent_id", "country"], TEXT_COLUMNS)
    return label_codes(text, ["country"])


def _answers(spark, sf):
    return target_answers(clean(spark, sf), TARGETS, ["respondent_id"], "country")


def encode_target(spark, sf):
    return class_table(_answers(spark, sf), CELL)


def _small(spark, sf):
    return clean_survey(V.survey_small(spark, sf), ["respondent_id", "country"])


def drop_rare_classes(spark, sf):
    answers = target_answers(_small(spark, sf), ["quality", "toxic", "source"], ["respondent_id"], "country")
    return class_distribution(class_table(answers, CELL), CELL)


def majority_baseline(spark, sf):
    return baseline(class_table(_answers(spark, sf), CELL), CELL).select(
        *CELL, "n_samples", "n_classes", r4(F.col("majority_baseline")).alias("majority_baseline"))


def eval_guards(spark, sf):
    """Small countries: too few classes, no available features, and fine cells."""
    p = build_profiles(_small(spark, sf), "respondent_id", "country", ["quality", "toxic"],
                       ["length_band", "source"])
    pairs = [F.struct(F.lit(s).alias("set_id"), F.lit(f).alias("feature")) for s, f in
             (("both", "source"), ("both", "length_band"), ("none", "gone"))]
    sets = (V.survey_small(spark, sf).select("country").distinct()
            .withColumn("target", F.explode(F.array(F.lit("quality"), F.lit("toxic"))))
            .withColumn("s", F.explode(F.array(*pairs)))
            .select("target", "country", "s.set_id", "s.feature"))
    return evaluation.evaluate_feature_sets(bayes.fit(p), sets)


def available_features(spark, sf):
    known = long(spark, sf).where(F.col("val").isNotNull()).select(F.col("var_code").alias("feature")).distinct()
    asked = V.survey_requests(spark, sf).withColumnRenamed("selected_code", "feature")
    return evaluation.available_features(asked, known, [*CELL, "condition"], "feature_rank")


def selected_features(spark, sf):
    return selected(V.mappings(spark, sf), [*CELL, "condition"])


def flatten_result(spark, sf):
    return evaluation.flatten(nested_comparison(V.grid_summary(spark, sf)))


def cost_value(spark, sf):
    return flatten_result(spark, sf).select(*CELL, "condition", "cost_of_imperfect", "value_over_random")


def error_rows(spark, sf):
    return evaluation.error_rows(flatten_result(spark, sf))


QUERIES = {
    "country_filter": country_filter, "valid_target": valid_target, "clean_numeric": clean_numeric,
    "clean_text": clean_text, "numeric_share": numeric_share, "drop_all_missing": drop_all_missing,
    "feature_pool": feature_pool, "dedupe_vars": dedupe_vars, "label_encode": label_encode,
    "encode_target": encode_target, "drop_rare_classes": drop_rare_classes,
    "majority_baseline": majority_baseline, "eval_guards": eval_guards,
    "available_features": available_features, "selected_features": selected_features,
    "flatten_result": flatten_result, "cost_value": cost_value, "error_rows": error_rows,
}

_TEXT_LONG = " UNION ALL ".join(f"SELECT country, '{c}' AS var_code, {c} AS val FROM survey_clean" for c in TEXT_COLUMNS)
_KINDS = [("q_priority", "text"), ("q_status", "text"), ("q_segment", "text"), ("q_balance", "number"),
          ("q_priority_code", "number")]
_TARGET_BOOK = {**CLEAN, **LONG, "answers": (["survey_clean"], answers_view("survey_clean", _KINDS)), **class_views("answers")}
_SMALL_BOOK = {
    "small_long": (["survey_small"], """
        SELECT respondent_id, 'source' AS var_code, source AS val FROM survey_small UNION ALL
        SELECT respondent_id, 'length_band', CAST(CAST(length_band AS BIGINT) AS VARCHAR) FROM survey_small"""),
    "small_sets": (["survey_small"], """
        SELECT t.target, c.country, s.set_id, s.feature FROM (SELECT DISTINCT country FROM survey_small) c
        CROSS JOIN (VALUES ('quality'), ('toxic')) t(target)
        CROSS JOIN (VALUES ('both', 'source'), ('both', 'length_band'), ('none', 'gone')) s(set_id, feature)"""),
}
_RARE = {**_SMALL_BOOK, "answers": (["survey_small"], answers_view(
    "survey_small", [("quality", "number"), ("toxic", "number"), ("source", "text")])), **class_views("answers")}
_GUARDS = {**_SMALL_BOOK, "answers": (["survey_small"], answers_view(
    "survey_small", [("quality", "number"), ("toxic", "number")])), **class_views("answers"),
    **bayes_views([]), "survey_long": (["small_long"], "SELECT * FROM small_long"), **_set_views("small_sets")}

SQL = {
    "country_filter": with_views("""SELECT respondent_id, country, q_status FROM survey_wide
        WHERE country = 'NATION_7'""", "survey_wide"),
    "valid_target": with_views("SELECT respondent_id, country, q_balance FROM survey_wide WHERE q_balance >= 0", "survey_wide"),
    "clean_numeric": with_views("""SELECT respondent_id, CASE WHEN q_balance >= 0 THEN q_balance END AS q_balance,
        CASE WHEN q_price >= 0 THEN q_price END AS q_price, q_month::DOUBLE AS q_month FROM survey_wide""", "survey_wide"),
    "clean_text": with_views(f"""SELECT respondent_id,
        CASE WHEN {share('q_priority_code')} > 0.5 AND ({num('q_priority_code')}) >= 0 THEN {num('q_priority_code')} END AS q_priority_code,
        CASE WHEN {share('q_mixed')} > 0.5 THEN NULL ELSE q_mixed END AS q_mixed,
        CASE WHEN {share('q_status')} > 0.5 THEN NULL ELSE q_status END AS q_status FROM survey_wide""", "survey_wide"),
    "numeric_share": with_views(f"SELECT {s6(share('q_priority_code'))} AS q_priority_code, "
                                f"{s6(share('q_mixed'))} AS q_mixed, {s6(share('q_status'))} AS q_status", "survey_wide"),
    "drop_all_missing": with_views("""SELECT country, var_code, count(val) AS n_answers FROM survey_long
        GROUP BY 1, 2 HAVING count(val) > 0""", "survey_long", extra=BOOK),
    "feature_pool": with_views("""SELECT country, var_code, count(val) AS n_answers FROM survey_long
        WHERE var_code NOT IN ('q_status', 'respondent_id', 'region', 'country_code', 'country')
        GROUP BY 1, 2 HAVING count(val) > 0""", "survey_long", extra=BOOK),
    "dedupe_vars": "SELECT user_id, event_type AS var_code, arg_min(props, event_id) AS val FROM events GROUP BY 1, 2",
    "label_encode": with_views(f"""SELECT country, var_code, val, n, row_number() OVER (PARTITION BY country, var_code ORDER BY val) - 1 AS code
        FROM (SELECT country, var_code, val, count(*) AS n FROM ({_TEXT_LONG}) WHERE val IS NOT NULL GROUP BY 1, 2, 3)""",
                               "survey_clean", extra=BOOK),
    "encode_target": with_views("SELECT target, country, answer, label, y, n FROM class_table", "class_table", extra=_TARGET_BOOK),
    "drop_rare_classes": with_views("""SELECT target, country, y, label, CAST(sum(n) AS BIGINT) AS n
        FROM class_table GROUP BY 1, 2, 3, 4""", "class_table", extra=_RARE),
    "majority_baseline": with_views(f"""SELECT target, country, n_samples, n_classes, {s4('majority_baseline')} AS majority_baseline
        FROM baseline""", "baseline", extra=_TARGET_BOOK),
    "eval_guards": with_views("SELECT * FROM set_result", "set_result", extra=_GUARDS),
    "available_features": with_views("""SELECT target, country, condition, selected_code AS feature, min(feature_rank) AS feature_rank
        FROM survey_requests WHERE selected_code IN (SELECT var_code FROM survey_long WHERE val IS NOT NULL) GROUP BY 1, 2, 3, 4""",
                                     "survey_requests", "survey_long", extra=BOOK),
    "selected_features": with_views("""SELECT target, country, condition, selected_code, min(feature_rank) AS feature_rank
        FROM mappings WHERE selected_code IS NOT NULL GROUP BY 1, 2, 3, 4""", "mappings"),
    "flatten_result": with_views(FLAT, "grid_summary"),
    "cost_value": with_views("SELECT target, country, condition, cost_of_imperfect, value_over_random FROM grid_summary", "grid_summary"),
    "error_rows": with_views("SELECT target, country, condition, error FROM grid_summary WHERE error IS NOT NULL", "grid_summary"),
}
