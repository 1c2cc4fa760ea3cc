"""Grid report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4
from surveyspark.operators import mapping
from surveyspark.operators.ranking import average_rank as rank_of
from surveyspark.plans import report
from surveyspark.queries import views as V
from surveyspark.queries.requesting import _TERMS
from surveyspark.queries.views import s3, s4, with_views

KEYS = report.KEYS


def _on_summary(fn):
    return lambda spark, sf: fn(V.grid_summary(spark, sf))


def _on_mappings(fn):
    return lambda spark, sf: fn(V.mappings(spark, sf))


def condition_deltas(spark, sf):
    d = report.condition_deltas(report.condition_pivot(V.grid_summary(spark, sf)))
    return d.select("target", "country", *[r4(F.col(c)).alias(c) for c in (
        "delta_model_acc", "delta_cost", "delta_value", "delta_k_mapped")])


def signal_rows(spark, sf):
    return report.signal_gap(V.grid_summary(spark, sf))


def average_rank(spark, sf):
    return rank_of(signal_rows(spark, sf), "signal", "signal_rank").select(*KEYS, "signal", "signal_rank")


def _rates(spark, sf):
    """Summary rows of the mapping cells, k taken from the mappings."""
    cells = mapping.requested_counts(V.mappings(spark, sf), KEYS).withColumn(
        "k_mapped", F.when(F.col("k_requested") % 5 > 0, F.col("k_mapped") % 8))
    return report.hit_rates(cells, V.mappings(spark, sf), V.importances(spark, sf))


def hit_rate(spark, sf):
    return _rates(spark, sf).withColumn("hit_codes", F.array_join("hit_codes", ","))


def hit_rate_by_target(spark, sf):
    return report.hit_rate_by_target(_rates(spark, sf))


def _covered(spark, sf):
    return mapping.coverage(V.mappings(spark, sf), KEYS)


def cell_report(spark, sf):
    r = report.cell_reports(V.mappings(spark, sf), V.importances(spark, sf))
    return r.select(
        *KEYS, "k",
        F.array_join(F.transform("oracle_top", lambda t: t["feature_variable"]), ",").alias("oracle_top"),
        F.array_join(F.transform("model_features", lambda t: F.concat(
            t["selected_code"], F.lit("="), t["feature_label"])), ",").alias("model_features"),
        F.array_join("hits", ",").alias("hits"))


def full_report(spark, sf):
    """Row count of every table of the full report."""
    tables = report.full_report(V.grid_summary(spark, sf), V.mappings(spark, sf), V.importances(spark, sf))
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "headline_table": _on_summary(report.headline_table),
    "headline_aggregate": _on_summary(report.headline_aggregate),
    "per_target_rollup": _on_summary(report.per_target_rollup),
    "condition_pivot": _on_summary(report.condition_pivot),
    "condition_deltas": condition_deltas,
    "condition_effect": _on_summary(lambda s: report.condition_effect(report.condition_pivot(s))),
    "signal_gap_rows": signal_rows,
    "signal_gap_pearson": _on_summary(lambda s: report.signal_gap_pearson(report.signal_gap(s))),
    "signal_gap_spearman": _on_summary(lambda s: report.signal_gap_spearman(report.signal_gap(s))),
    "average_rank": average_rank,
    "hit_rate": hit_rate,
    "hit_rate_by_target": hit_rate_by_target,
    "coverage": _covered,
    "coverage_profile": lambda spark, sf: report.coverage_profile(_covered(spark, sf)),
    "worst_coverage": lambda spark, sf: report.worst_coverage(_covered(spark, sf)),
    "lead_feature": _on_mappings(report.lead_features),
    "lead_summary": _on_mappings(lambda m: report.lead_summary(report.lead_features(m))),
    "extreme_cells": _on_summary(report.extreme_cells),
    "cell_report": cell_report,
    "full_report": full_report,
}

_ONE = "CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END"


def _share(cond: str) -> str:
    return s3("avg(" + _ONE.format(c=cond) + ")")


_NUM = ["majority_baseline", "oracle_acc", "model_acc", "random_acc", "cost_of_imperfect", "value_over_random"]
_PIVOT = {"pivoted": (["grid_summary"], "SELECT target, country, " + ", ".join(
    f"avg({m}) FILTER (condition = '{c}') AS {m}__{c}" for m in report.PIVOT_METRICS
    for c in ("country_provided", "unprompted")) + " FROM grid_summary GROUP BY 1, 2")}
_D = {"delta_model_acc": "model_acc", "delta_cost": "cost_of_imperfect", "delta_value": "value_over_random",
      "delta_k_mapped": "k_mapped"}
_DELTA = {**_PIVOT, "deltas": (["pivoted"], "SELECT target, country, " + ", ".join(
    f"{m}__country_provided - {m}__unprompted AS {d}" for d, m in _D.items()) + " FROM pivoted")}
_SIGNAL = {"signals": (["grid_summary"], f"""SELECT target, country, condition, {s4('oracle_acc - majority_baseline')} AS signal,
    {s4('cost_of_imperfect')} AS gap FROM grid_summary
    WHERE oracle_acc IS NOT NULL AND majority_baseline IS NOT NULL AND cost_of_imperfect IS NOT NULL""")}
_RANKED = {**_SIGNAL, "ranked": (["signals"], """SELECT *,
    rank() OVER (ORDER BY signal) + (count(*) OVER (PARTITION BY signal) - 1) / 2.0::DOUBLE AS signal_rank,
    rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2.0::DOUBLE AS gap_rank FROM signals""")}
_HITS = {
    "cells_k": (["mappings"], """SELECT target, country, condition, CASE WHEN count(*) % 5 > 0 THEN count(DISTINCT selected_code) % 8 END AS k
        FROM mappings GROUP BY 1, 2, 3"""),
    "top_n": (["importances"], """SELECT target_variable AS target, country, feature_variable, importance_mean, row_number() OVER (
        PARTITION BY target_variable, country ORDER BY importance_mean DESC, feature_variable) AS rn FROM importances"""),
    "sel": (["mappings"], """SELECT target, country, condition, selected_code, min(feature_rank) AS feature_rank,
        arg_min(feature_label, feature_rank) AS feature_label FROM mappings WHERE selected_code IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "rates": (["cells_k", "top_n", "sel"], f"""
        SELECT c.target, c.country, c.condition, coalesce(c.k, 0) AS k_mapped, coalesce(h.n, 0) AS n_hits,
               CASE WHEN coalesce(c.k, 0) > 0 THEN {s3('coalesce(h.n, 0)::DOUBLE / c.k')} END AS hit_rate, coalesce(h.codes, '') AS hit_codes
        FROM cells_k c LEFT JOIN (
          SELECT s.target, s.country, s.condition, count(*) AS n, string_agg(s.selected_code, ',' ORDER BY s.feature_rank, s.selected_code) AS codes
          FROM sel s JOIN cells_k k ON k.target = s.target AND k.country = s.country AND k.condition = s.condition
          JOIN top_n t ON t.target = s.target AND t.country = s.country AND t.feature_variable = s.selected_code AND t.rn <= k.k
          GROUP BY 1, 2, 3) h ON h.target = c.target AND h.country = c.country AND h.condition = c.condition"""),
}
_LABEL = "CASE target " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.TARGET_LABELS.items()) + " END"
_COV = {"covered": (["mappings"], f"""
    SELECT target, country, condition, n_asked, n_unmappable, n_asked - n_unmappable - n_usable AS n_duplicates_dropped, n_usable,
           {s3('n_unmappable::DOUBLE / n_asked')} AS unmappable_rate
    FROM (SELECT target, country, condition, count(*) AS n_asked, count(*) FILTER (selected_code IS NULL) AS n_unmappable,
                 count(DISTINCT selected_code) AS n_usable FROM mappings GROUP BY 1, 2, 3)""")}
_LEAD = {"leads": (["mappings"], f"""
    SELECT target, country, condition, rank0_label, len(list_filter({_TERMS}, lambda t: contains(lower(rank0_label), t))) > 0 AS rank0_is_demographic
    FROM (SELECT target, country, condition, arg_min(feature_label, feature_rank) AS rank0_label FROM mappings GROUP BY 1, 2, 3)""")}
_EXT = f"""SELECT '{{w}}' AS which, target, country, condition, {s4('cost_of_imperfect')} AS cost FROM grid_summary
    WHERE cost_of_imperfect IS NOT NULL AND k_mapped >= 3 {{more}} ORDER BY cost_of_imperfect {{d}}, target, country, condition LIMIT 1"""

SQL = {
    "headline_table": with_views(f"""SELECT target, country, condition, k_requested, k_mapped,
        {s4('1 - k_mapped::DOUBLE / nullif(k_requested, 0)')} AS unmappable_rate,
        {', '.join(f'{s4(c)} AS {c}' for c in _NUM)} FROM grid_summary""", "grid_summary"),
    "headline_aggregate": with_views(f"""SELECT count(*) AS n_cells_rows, {s4('avg(oracle_acc)')} AS mean_oracle,
        {s4('avg(model_acc)')} AS mean_model, {s4('avg(random_acc)')} AS mean_random, {s4('avg(majority_baseline)')} AS mean_majority,
        {s4('avg(cost_of_imperfect)')} AS mean_cost, {s4('avg(value_over_random)')} AS mean_value,
        {_share('value_over_random > 0')} AS share_model_beats_random, {_share('model_acc > majority_baseline')} AS share_model_beats_majority,
        {_share('oracle_acc > majority_baseline')} AS share_oracle_beats_majority
        FROM grid_summary WHERE oracle_acc IS NOT NULL AND model_acc IS NOT NULL AND random_acc IS NOT NULL""", "grid_summary"),
    "per_target_rollup": with_views(f"""SELECT target, count(*) AS n_rows, {s4('avg(cost_of_imperfect)')} AS mean_cost,
        {s4('stddev_samp(cost_of_imperfect)')} AS std_cost, {s4('avg(value_over_random)')} AS mean_value,
        {s4('stddev_samp(value_over_random)')} AS std_value, {s4('avg(oracle_acc)')} AS mean_oracle, {s4('avg(model_acc)')} AS mean_model,
        {s4('avg(random_acc)')} AS mean_random, {s4('avg(' + _ONE.format(c='value_over_random > 0') + ')')} AS share_value_positive,
        {_LABEL} AS target_label FROM grid_summary
        WHERE cost_of_imperfect IS NOT NULL AND value_over_random IS NOT NULL GROUP BY target""", "grid_summary"),
    "condition_pivot": with_views("SELECT * FROM pivoted", "pivoted", extra=_PIVOT),
    "condition_deltas": with_views("SELECT target, country, " + ", ".join(f"{s4(d)} AS {d}" for d in _D) + " FROM deltas",
                                   "deltas", extra=_DELTA),
    "condition_effect": with_views(f"""SELECT {s4('avg(d)')} AS mean_delta_model_acc, {s4('median(d)')} AS median_delta_model_acc,
        {_share('d > 0')} AS share_cp_beats_up, {s3('avg(delta_k_mapped)')} AS mean_delta_k_mapped, count(*) AS n_cells
        FROM (SELECT {s4('delta_model_acc')} AS d, delta_k_mapped FROM deltas) WHERE d IS NOT NULL""", "deltas", extra=_DELTA),
    "signal_gap_rows": with_views("SELECT * FROM signals", "signals", extra=_SIGNAL),
    "signal_gap_pearson": with_views(f"SELECT {s3('corr(signal, gap)')} AS pearson, count(*) AS n FROM signals", "signals", extra=_SIGNAL),
    "signal_gap_spearman": with_views(f"SELECT {s3('corr(signal_rank, gap_rank)')} AS spearman, count(*) AS n FROM ranked",
                                      "ranked", extra=_RANKED),
    "average_rank": with_views("SELECT target, country, condition, signal, signal_rank FROM ranked", "ranked", extra=_RANKED),
    "hit_rate": with_views("SELECT * FROM rates", "rates", extra=_HITS),
    "hit_rate_by_target": with_views(f"""SELECT target, count(*) AS n_rows, {s4('avg(hit_rate)')} AS mean_hit_rate,
        CAST(sum(n_hits) AS BIGINT) AS total_hits, CAST(sum(k_mapped) AS BIGINT) AS total_k,
        {s3('sum(n_hits)::DOUBLE / sum(k_mapped)')} AS pooled_hit_rate, {_LABEL} AS target_label
        FROM rates WHERE hit_rate IS NOT NULL GROUP BY target""", "rates", extra=_HITS),
    "coverage": with_views("SELECT * FROM covered", "covered", extra=_COV),
    "coverage_profile": with_views(f"""SELECT target, country, condition, {s3('avg(unmappable_rate)')} AS mean_unmappable_rate,
        CAST(sum(n_asked) AS BIGINT) AS total_asked, CAST(sum(n_unmappable) AS BIGINT) AS total_unmappable,
        CAST(sum(n_duplicates_dropped) AS BIGINT) AS total_dup_dropped
        FROM covered GROUP BY GROUPING SETS ((target), (country), (condition), ())""", "covered", extra=_COV),
    "worst_coverage": with_views("""SELECT * FROM covered ORDER BY unmappable_rate DESC, target, country, condition LIMIT 8""",
                                 "covered", extra=_COV),
    "lead_feature": with_views("SELECT * FROM leads", "leads", extra=_LEAD),
    "lead_summary": with_views(f"""SELECT condition, target, count(*) AS n_cells, {_share('rank0_is_demographic')} AS share_rank0_demographic
        FROM leads GROUP BY GROUPING SETS ((condition), (target), ())""", "leads", extra=_LEAD),
    "extreme_cells": with_views("SELECT * FROM (" + _EXT.format(w="high_cost", more="", d="DESC") + ") UNION ALL SELECT * FROM ("
                                + _EXT.format(w="low_cost", d="ASC", more=f"""AND cost_of_imperfect >= 0
                                AND {s4('oracle_acc - majority_baseline')} >= 0.05""") + ")", "grid_summary"),
    "cell_report": with_views("""
        SELECT w.target, w.country, w.condition, w.k, t.tops AS oracle_top, s.feats AS model_features, coalesce(s.hits, '') AS hits
        FROM (SELECT target, country, condition, count(DISTINCT selected_code) AS k FROM mappings GROUP BY 1, 2, 3) w
        LEFT JOIN (SELECT k.target, k.country, k.condition, string_agg(feature_variable, ',' ORDER BY rn) AS tops
                   FROM (SELECT target, country, condition, count(DISTINCT selected_code) AS k FROM mappings GROUP BY 1, 2, 3) k
                   JOIN top_n t ON t.target = k.target AND t.country = k.country AND t.rn <= greatest(k.k, 10) GROUP BY 1, 2, 3) t
          ON t.target = w.target AND t.country = w.country AND t.condition = w.condition
        LEFT JOIN (SELECT s.target, s.country, s.condition,
                     string_agg(s.selected_code || '=' || s.feature_label, ',' ORDER BY s.feature_rank) AS feats,
                     string_agg(s.selected_code, ',' ORDER BY s.feature_rank) FILTER (t.rn <= k.k) AS hits
                   FROM sel s JOIN (SELECT target, country, condition, count(DISTINCT selected_code) AS k FROM mappings GROUP BY 1, 2, 3) k
                     ON k.target = s.target AND k.country = s.country AND k.condition = s.condition
                   LEFT JOIN top_n t ON t.target = s.target AND t.country = s.country AND t.feature_variable = s.selected_code
                   GROUP BY 1, 2, 3) s ON s.target = w.target AND s.country = w.country AND s.condition = w.condition""",
                              "mappings", "top_n", "sel", extra=_HITS),
}
