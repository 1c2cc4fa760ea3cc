"""Sources, sinks and catalog lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators.evaluation import flatten
from surveyspark.operators.requests import parse_responses
from surveyspark.queries import views as V
from surveyspark.queries.views import s4, with_views
from surveyspark.session import scratch_path
from surveyspark.sources import catalog, tables

SUMMARY_COLUMNS = ["target", "country", "country_code", "condition", "k_requested", "k_mapped",
                   "majority_baseline", "oracle_acc", "oracle_std", "model_acc", "model_std",
                   "random_acc", "random_std", "cost_of_imperfect", "value_over_random", "error"]


def scan_survey(spark, sf):
    df = catalog.scan_survey(spark, f"{sf}/customer.parquet", country_col="c_nationkey")
    return df.select("c_custkey", "country", "c_mktsegment", "c_acctbal")


def variable_index(spark, sf):
    return catalog.variable_index(V.variables(spark, sf))


def question_text(spark, sf):
    codes = V.table(spark, sf, "labels").select(F.concat(F.lit("V"), F.col("doc_id") * 2).alias("var_code"))
    return catalog.question_texts(V.variables(spark, sf), codes)


def admin_vars(spark, sf):
    return catalog.admin_variables(V.variables(spark, sf), "country")


def oracle_scan(spark, sf):
    path = scratch_path(spark, "importances")
    tables.write_importances(V.importances(spark, sf), path)
    return tables.read_importances(spark, path)


def oracle_scan_target(spark, sf):
    """One target read back: only its partition is scanned."""
    path = scratch_path(spark, "importances")
    tables.write_importances(V.importances(spark, sf), path)
    return tables.read_importances(spark, path, "purchase").select("country", "feature_variable", "importance_mean")


def mapping_records(df):
    """Mapping view rows in the stored record shape."""
    empty = F.array().cast("array<struct<var_code:string,question_text:string,similarity:double>>")
    none = F.lit(None).cast("string")
    return df.select(
        "target", "country", "condition", F.lit("m1").alias("model"), "feature_label",
        F.lit("").alias("feature_reasoning"), F.col("feature_rank").cast("bigint").alias("feature_rank"),
        empty.alias("candidates"), F.col("selected_code").alias("top_match_code"),
        F.lit(None).cast("double").alias("top_match_score"),
        F.struct(F.col("selected_code"), none.alias("selected_text"), F.lit(None).cast("int").alias("selected_rank"),
                 F.lit("B").alias("raw_response")).alias("disambig"))


def mapping_json(spark, sf):
    path = scratch_path(spark, "mappings")
    tables.write_json(mapping_records(V.mappings(spark, sf)), path)
    return tables.read_mappings(spark, path).select(
        "target", "country", "condition", "feature_label", "feature_rank",
        F.col("disambig.selected_code").alias("selected_code"))


def nested_comparison(summary):
    """Summary rows in the nested comparison shape."""
    n = F.lit(None).cast("bigint")
    text = F.lit(None).cast("string")

    def part(kind):
        return F.when(F.col(f"{kind}_acc").isNotNull(), F.struct(
            F.col(f"{kind}_acc").alias("accuracy_mean"), F.col(f"{kind}_std").alias("accuracy_std"),
            F.col("majority_baseline"), F.col("k_mapped").alias("n_features"),
            F.col("k_requested").alias("n_features_requested"), n.alias("n_samples"), text.alias("error")))

    rand = F.struct(F.col("random_acc").alias("accuracy_mean"), F.col("random_std").alias("accuracy_std"),
                    F.lit(20).cast("bigint").alias("n_draws"))
    return summary.select("target", "country", "condition", "k_requested", "k_mapped",
                          part("oracle").alias("oracle"), part("model").alias("model"), rand.alias("random"), "error")


def evaluation_json(spark, sf):
    path = scratch_path(spark, "evaluations")
    tables.write_evaluations(nested_comparison(V.grid_summary(spark, sf)), path)
    return flatten(tables.read_evaluations(spark, path))


def nested_results(spark, sf):
    """The whole nested result as one JSON record per cell and condition."""
    path = scratch_path(spark, "results")
    nested = nested_comparison(V.grid_summary(spark, sf))
    tables.write_json(nested, path, ("target", "country", "condition"))
    return flatten(spark.read.schema(nested.schema).json(path))


def grid_summary_scan(spark, sf):
    path = scratch_path(spark, "summary")
    tables.write_summary(V.grid_summary(spark, sf), path)
    return tables.read_summary(spark, path).select(*SUMMARY_COLUMNS, "cell")


def grid_summary_sink(spark, sf):
    """A second run over one target replaces its cells and keeps the others."""
    path = scratch_path(spark, "summary")
    summary = V.grid_summary(spark, sf)
    tables.write_summary(summary, path)
    again = summary.where(F.col("target") == "BUILDING").withColumn("k_mapped", F.lit(0).cast("bigint"))
    tables.write_summary(again, path)
    return tables.read_summary(spark, path).select(*SUMMARY_COLUMNS, "cell")


def summary_roundtrip(spark, sf):
    """What a comparison gives, written as a summary and read back."""
    path = scratch_path(spark, "summary")
    codes = V.table(spark, sf, "nation").select(F.col("n_name").alias("country_name"), F.col("n_nationkey").cast("string").alias("country_code"))
    tables.write_summary(flatten(nested_comparison(V.grid_summary(spark, sf)), codes), path)
    return tables.read_summary(spark, path)


def importance_resume(spark, sf):
    """A second run over one country replaces its cells and keeps all others."""
    path = scratch_path(spark, "importances")
    df = V.importances(spark, sf)
    tables.write_importances(df, path)
    again = df.where("country = 'C1'").withColumn("importance_mean", F.lit(0.5))
    tables.write_importances(again, path)
    return tables.read_importances(spark, path)


def batch_results(spark, sf):
    path = scratch_path(spark, "responses")
    parsed = parse_responses(V.responses(spark, sf)).select(
        "target", F.concat(F.lit("doc "), "response_id").alias("question_text"), "country", "condition",
        F.lit("m1").alias("model"), "raw_response", "features", F.col("n_features").cast("bigint").alias("n_features"),
        "parse_error")
    tables.write_json(tables.stamp(parsed), path)
    back = tables.read_responses(spark, path)
    return back.select("question_text", "target", "country", "condition", "n_features",
                       F.col("parse_error").isNotNull().alias("failed"), F.col("timestamp").isNotNull().alias("stamped"),
                       F.md5(F.col("raw_response").cast("binary")).alias("raw_md5"))


def stale_variables(spark, sf):
    docs = V.table(spark, sf, "documents")
    cached = docs.select(F.concat(F.lit("V"), "doc_id").alias("var_code"),
                         F.md5(F.regexp_replace("text", r"^\s+|\s+$", "").cast("binary")).alias("text_md5"),
                         F.when(F.col("lang") == "de", "m0").otherwise("m1").alias("model"))
    index = catalog.variable_index(V.variables(spark, sf))
    return catalog.stale_variables(index, cached, "m1").select("var_code", "text_md5", "model")


def vector_upsert(spark, sf):
    """The vector cache of two models after a first write, a change of every third vector and new codes."""
    path = scratch_path(spark, "vectors")
    emb, i = V.table(spark, sf, "embeddings"), F.col("vec_id")
    named = lambda letter, state: (F.concat(F.lit(letter), i).alias("var_code"), F.md5(F.concat(F.lit(state), i)).alias("text_md5"))
    turned = F.transform("embedding", lambda x: -x).alias("vector")
    for model in ("m0", "m1"):
        tables.upsert_vectors(spark, emb.select(*named("V", "old"), F.col("embedding").alias("vector")), path, model)
    fresh = emb.where(i % 3 == 0).select(*named("V", "new"), turned).unionByName(emb.where(i % 7 == 0).select(*named("W", "new"), turned))
    tables.upsert_vectors(spark, fresh, path, "m1", live=emb.where(i % 10 != 9).select(F.explode(F.array(*(
        F.concat(F.lit(x), i) for x in "VW"))).alias("var_code")))
    both = tables.read_vectors(spark, path, "m0").unionByName(tables.read_vectors(spark, path, "m1"))
    return both.select("var_code", "model", "text_md5", F.size("vector").cast("bigint").alias("n"),
                       F.get("vector", F.lit(0)).cast("double").alias("first"))


def pending_cells(spark, sf):
    e = V.table(spark, sf, "events").select(
        F.col("event_type").alias("target"), F.concat(F.lit("C"), "user_id").alias("country"), "value")
    return catalog.pending_cells(e.select("target", "country").distinct(), e.where(F.col("value") > 150),
                                 ["target", "country"])


def _nation_values(spark, sf):
    return V.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("ordinal"), F.col("n_name").alias("country_name"),
        F.col("n_nationkey").cast("string").alias("code"))


def country_map_codes(spark, sf):
    data = V.table(spark, sf, "customer")
    return catalog.country_map(_nation_values(spark, sf), data, "c_nationkey")


def country_map_names(spark, sf):
    key = F.col("c_nationkey")
    data = V.table(spark, sf, "customer").select(
        F.when(key % 3 == 0, F.concat(F.lit("nation_"), key)).when(key % 3 == 1, F.concat(F.lit("NATION_"), key))
        .otherwise(F.concat(F.lit("LAND "), key)).alias("land"))
    return catalog.country_map(_nation_values(spark, sf), data, "land")


def list_countries(spark, sf):
    return catalog.list_countries(country_map_codes(spark, sf))


def unknown_countries(spark, sf):
    asked = V.table(spark, sf, "customer").select(
        F.concat(F.lit("NATION_"), F.col("c_custkey") % 40).alias("country_name"))
    return catalog.unknown_countries(asked, country_map_codes(spark, sf))


QUERIES = {
    "scan_survey": scan_survey, "variable_index": variable_index, "question_text": question_text,
    "admin_vars": admin_vars, "oracle_scan": oracle_scan, "oracle_scan_target": oracle_scan_target,
    "mapping_json": mapping_json, "evaluation_json": evaluation_json, "nested_results": nested_results,
    "grid_summary_scan": grid_summary_scan, "grid_summary_sink": grid_summary_sink,
    "summary_roundtrip": summary_roundtrip, "importance_resume": importance_resume,
    "batch_results": batch_results, "stale_variables": stale_variables, "vector_upsert": vector_upsert, "pending_cells": pending_cells,
    "country_map_codes": country_map_codes, "country_map_names": country_map_names,
    "list_countries": list_countries, "unknown_countries": unknown_countries,
}

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TEXT = _STRIP.format(x="coalesce(nullif(question, ''), nullif(description, ''), '')")
INDEX = {"variable_texts": (["variables"], f"""
    SELECT var_code, arg_max(text, ordinal) AS question_text
    FROM (SELECT ordinal, var_code, {_TEXT} AS text FROM variables WHERE section <> 'EXCLUDED')
    WHERE text <> '' GROUP BY 1""")}

# responses parsed on the SQL side
PARSED = {"parsed": (["responses"], r"""
    SELECT *, CASE WHEN is_list AND json_array_length(body) > 0 THEN json_array_length(body) END AS n_features FROM (
      SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'ARRAY' ELSE false END AS is_list,
             CASE WHEN country IS NULL THEN 'unprompted' ELSE 'country_provided' END AS condition
      FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw_response, '^\s+|\s+$', '', 'g'),
              '^```(?:json)?\s*', ''), '\s*```$', '') AS body FROM responses))""")}

FLAT = f"""SELECT target, country, country AS country_code, condition, k_requested, k_mapped,
    majority_baseline, oracle_acc, oracle_std, model_acc, CASE WHEN model_acc IS NOT NULL THEN model_std END AS model_std,
    random_acc, random_std, {s4('oracle_acc - model_acc')} AS cost_of_imperfect,
    {s4('model_acc - random_acc')} AS value_over_random, error FROM grid_summary"""
_COLS = ", ".join(SUMMARY_COLUMNS)
_CODES = """SELECT n_name AS country_name, CAST(n_nationkey AS VARCHAR) AS country_code FROM nation
    WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)"""

SQL = {
    "scan_survey": "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS country, c_mktsegment, c_acctbal FROM customer",
    "variable_index": with_views("SELECT * FROM variable_texts", "variable_texts", extra=INDEX),
    "question_text": with_views(f"""
        SELECT c.var_code, t.question_text FROM (SELECT DISTINCT 'V' || (doc_id * 2) AS var_code FROM labels) c
        LEFT JOIN (SELECT var_code, {_STRIP.format(x="coalesce(nullif(question, ''), nullif(description, ''), var_code)")} AS question_text
                   FROM (SELECT *, row_number() OVER (PARTITION BY var_code ORDER BY ordinal) AS rn FROM variables) WHERE rn = 1) t
          ON t.var_code = c.var_code""", "variables"),
    "admin_vars": with_views("""SELECT DISTINCT var_code FROM (SELECT var_code FROM variables WHERE section = 'EXCLUDED'
        UNION ALL SELECT 'country')""", "variables"),
    "oracle_scan": with_views("SELECT * FROM importances", "importances"),
    "oracle_scan_target": with_views("""SELECT country, feature_variable, importance_mean FROM importances
        WHERE target_variable = 'purchase'""", "importances"),
    "mapping_json": with_views("SELECT * FROM mappings", "mappings"),
    "evaluation_json": with_views(FLAT, "grid_summary"),
    "nested_results": with_views(FLAT, "grid_summary"),
    "grid_summary_scan": with_views(f"SELECT {_COLS}, target || '_' || country AS cell FROM grid_summary", "grid_summary"),
    "grid_summary_sink": with_views(f"""SELECT * REPLACE (CASE WHEN target = 'BUILDING' THEN 0 ELSE k_mapped END AS k_mapped),
        target || '_' || country AS cell FROM (SELECT {_COLS} FROM grid_summary)""", "grid_summary"),
    "summary_roundtrip": with_views(f"""SELECT *, target || '_' || country AS cell FROM (
        {FLAT.replace('country AS country_code', 'country_code')})""", "grid_summary"),
    "importance_resume": with_views("""SELECT * REPLACE (CASE WHEN country = 'C1' THEN 0.5 ELSE importance_mean END AS importance_mean)
        FROM importances""", "importances"),
    "batch_results": with_views("""SELECT 'doc ' || response_id AS question_text, target, country, condition,
        CAST(n_features AS BIGINT) AS n_features, NOT is_list AS failed, true AS stamped, md5(raw_response) AS raw_md5 FROM parsed""",
                                "parsed", extra=PARSED),
    "stale_variables": with_views(r"""
        SELECT t.var_code, md5(t.question_text) AS text_md5, 'm1' AS model FROM variable_texts t
        WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE 'V' || d.doc_id = t.var_code AND d.lang <> 'de'
          AND md5(regexp_replace(d.text, '^\s+|\s+$', '', 'g')) = md5(t.question_text))""", "variable_texts", extra=INDEX),
    "vector_upsert": """
        WITH old AS (SELECT 'V' || vec_id AS var_code, 'm0' AS model, md5('old' || vec_id) AS text_md5, embedding AS v, vec_id FROM embeddings
                     UNION ALL SELECT 'V' || vec_id, 'm1', md5('old' || vec_id), embedding, vec_id FROM embeddings WHERE vec_id % 3 <> 0),
         new AS (SELECT 'V' || vec_id AS var_code, 'm1' AS model, md5('new' || vec_id) AS text_md5, [-x FOR x IN embedding] AS v, vec_id FROM embeddings WHERE vec_id % 3 = 0
                 UNION ALL SELECT 'W' || vec_id, 'm1', md5('new' || vec_id), [-x FOR x IN embedding], vec_id FROM embeddings WHERE vec_id % 7 = 0)
        SELECT var_code, model, text_md5, len(v) AS n, CAST(v[1] AS DOUBLE) AS first FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
        WHERE model = 'm0' OR vec_id % 10 <> 9""",
    "pending_cells": """SELECT DISTINCT event_type AS target, 'C' || user_id AS country FROM events e
        WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = e.event_type AND d.user_id = e.user_id AND d.value > 150)""",
    "country_map_codes": _CODES,
    "country_map_names": """
        WITH found AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'nation_' || c_nationkey
            WHEN 1 THEN 'NATION_' || c_nationkey ELSE 'LAND ' || c_nationkey END AS v FROM customer)
        SELECT n_name AS country_name, v AS country_code FROM nation JOIN found ON lower(v) = lower(n_name)
        UNION ALL SELECT v, v FROM found WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(v))""",
    "list_countries": _CODES,
    "unknown_countries": f"""SELECT DISTINCT 'NATION_' || (c_custkey % 40) AS country_name FROM customer
        WHERE 'NATION_' || (c_custkey % 40) NOT IN (SELECT country_name FROM ({_CODES}))""",
}
