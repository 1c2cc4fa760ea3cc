"""Grid report: rollups, pivots, correlations, hit rates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.numbers import pearson, r3, r4, share
from surveyspark.functions.text import COUNTRY_PROVIDED, UNPROMPTED, is_demographic
from surveyspark.operators.importance import importance_rank
from surveyspark.operators.mapping import coverage, flag_hits, selected_features
from surveyspark.operators.ranking import average_rank
from surveyspark.session import materialize

# Names of the default grid's targets.
TARGET_LABELS = {
    "Q47": "Self-rated health",
    "Q57": "Interpersonal trust",
    "Q199": "Political interest",
    "Q235": "Strong leader",
    "Q164": "Importance of God",
}
KEYS = ["target", "country", "condition"]
PIVOT_METRICS = ["model_acc", "cost_of_imperfect", "value_over_random", "k_mapped"]


def target_label(target: Column, labels: dict[str, str] = TARGET_LABELS) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.try_element_at(pairs, target)


def headline_table(summary: DataFrame) -> DataFrame:
    rate = 1 - F.col("k_mapped") / F.nullif("k_requested", F.lit(0))
    numbers = ["majority_baseline", "oracle_acc", "model_acc", "random_acc",
               "cost_of_imperfect", "value_over_random"]
    return summary.select(*KEYS, "k_requested", "k_mapped", r4(rate).alias("unmappable_rate"),
                          *[r4(F.col(c)).alias(c) for c in numbers])


def headline_aggregate(summary: DataFrame) -> DataFrame:
    full = summary.dropna(subset=["oracle_acc", "model_acc", "random_acc"])
    value, model, oracle, base = (F.col(c) for c in (
        "value_over_random", "model_acc", "oracle_acc", "majority_baseline"))
    return full.agg(
        F.count(F.lit(1)).alias("n_cells_rows"),
        r4(F.avg("oracle_acc")).alias("mean_oracle"), r4(F.avg("model_acc")).alias("mean_model"),
        r4(F.avg("random_acc")).alias("mean_random"), r4(F.avg("majority_baseline")).alias("mean_majority"),
        r4(F.avg("cost_of_imperfect")).alias("mean_cost"), r4(F.avg("value_over_random")).alias("mean_value"),
        r3(share(value > 0)).alias("share_model_beats_random"),
        r3(share(model > base)).alias("share_model_beats_majority"),
        r3(share(oracle > base)).alias("share_oracle_beats_majority"))


def per_target_rollup(summary: DataFrame) -> DataFrame:
    full = summary.dropna(subset=["cost_of_imperfect", "value_over_random"])
    rolled = full.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r4(F.avg("cost_of_imperfect")).alias("mean_cost"), r4(F.stddev_samp("cost_of_imperfect")).alias("std_cost"),
        r4(F.avg("value_over_random")).alias("mean_value"), r4(F.stddev_samp("value_over_random")).alias("std_value"),
        r4(F.avg("oracle_acc")).alias("mean_oracle"), r4(F.avg("model_acc")).alias("mean_model"),
        r4(F.avg("random_acc")).alias("mean_random"),
        r4(share(F.col("value_over_random") > 0)).alias("share_value_positive"))
    return rolled.withColumn("target_label", target_label(F.col("target")))


def condition_pivot(summary: DataFrame) -> DataFrame:
    """One row per cell with ``metric__condition`` columns."""
    conditions = [COUNTRY_PROVIDED, UNPROMPTED]
    wide = summary.groupBy("target", "country").pivot("condition", conditions).agg(
        *[F.avg(m).alias(m) for m in PIVOT_METRICS])
    return wide.select("target", "country", *[
        F.col(f"{c}_{m}").alias(f"{m}__{c}") for m in PIVOT_METRICS for c in conditions])


def condition_deltas(pivot: DataFrame) -> DataFrame:
    """Country-provided minus unprompted."""
    names = {"model_acc": "delta_model_acc", "cost_of_imperfect": "delta_cost",
             "value_over_random": "delta_value", "k_mapped": "delta_k_mapped"}
    return pivot.withColumns({
        out: F.col(f"{m}__{COUNTRY_PROVIDED}") - F.col(f"{m}__{UNPROMPTED}") for m, out in names.items()})


def condition_effect(pivot: DataFrame) -> DataFrame:
    # four decimals hold a difference of two rounded accuracies in full, and
    # keep the number of distinct values the exact median has to count small
    clean = condition_deltas(pivot).withColumn("delta_model_acc", r4(F.col("delta_model_acc"))) \
        .dropna(subset=["delta_model_acc"])
    return clean.agg(
        r4(F.avg("delta_model_acc")).alias("mean_delta_model_acc"),
        r4(F.median("delta_model_acc")).alias("median_delta_model_acc"),
        r3(share(F.col("delta_model_acc") > 0)).alias("share_cp_beats_up"),
        r3(F.avg("delta_k_mapped")).alias("mean_delta_k_mapped"),
        F.count(F.lit(1)).alias("n_cells"))


def signal_gap(summary: DataFrame) -> DataFrame:
    """Signal (oracle over majority) and gap (cost), four decimals."""
    full = summary.dropna(subset=["oracle_acc", "majority_baseline", "cost_of_imperfect"])
    return full.select(*KEYS, r4(F.col("oracle_acc") - F.col("majority_baseline")).alias("signal"),
                       r4(F.col("cost_of_imperfect")).alias("gap"))


def signal_gap_pearson(rows: DataFrame) -> DataFrame:
    return rows.agg(r3(pearson("signal", "gap")).alias("pearson"), F.count(F.lit(1)).alias("n"))


def signal_gap_spearman(rows: DataFrame) -> DataFrame:
    ranked = average_rank(average_rank(rows, "signal", "signal_rank"), "gap", "gap_rank")
    return ranked.agg(r3(pearson("signal_rank", "gap_rank")).alias("spearman"), F.count(F.lit(1)).alias("n"))


def hit_rates(summary: DataFrame, mappings: DataFrame, importances: DataFrame) -> DataFrame:
    """How many selected features are among the k most important ones.

    The rate is NULL when k is 0 or the cell has no mapping or importance rows.
    """
    cell = ["target", "country"]
    k = summary.select(*KEYS, F.coalesce("k_mapped", F.lit(0)).cast("bigint").alias("k_mapped"))
    ranked = importance_rank(importances).withColumnRenamed("target_variable", "target")
    top = ranked.join(k, cell).where(F.col("rank") <= F.col("k_mapped"))
    hits = (flag_hits(selected_features(mappings, KEYS), top, KEYS).where("hit")
            .groupBy(*KEYS).agg(
                F.count(F.lit(1)).alias("_hits"),
                F.array_sort(F.collect_list(F.struct("feature_rank", "selected_code"))).alias("_codes")))
    has_map = mappings.select(*cell).distinct().withColumn("_map", F.lit(True))
    has_imp = ranked.select(*cell).distinct().withColumn("_imp", F.lit(True))
    known = (F.col("k_mapped") > 0) & F.col("_map").isNotNull() & F.col("_imp").isNotNull()
    n_hits = F.when(known, F.coalesce("_hits", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    codes = F.transform(F.coalesce("_codes", F.array().cast("array<struct<feature_rank:bigint,selected_code:string>>")),
                        lambda s: s["selected_code"])
    return (
        k.join(hits, KEYS, "left").join(has_map, cell, "left").join(has_imp, cell, "left")
        .select(*KEYS, "k_mapped", n_hits.alias("n_hits"),
                F.when(known, r3(n_hits / F.col("k_mapped"))).alias("hit_rate"),
                F.when(known, codes).otherwise(F.array().cast("array<string>")).alias("hit_codes"))
    )


def hit_rate_by_target(rates: DataFrame) -> DataFrame:
    """Mean of the rates, and the pooled rate over all features."""
    return (
        rates.dropna(subset=["hit_rate"]).groupBy("target").agg(
            F.count(F.lit(1)).alias("n_rows"), r4(F.avg("hit_rate")).alias("mean_hit_rate"),
            F.sum("n_hits").alias("total_hits"), F.sum("k_mapped").alias("total_k"))
        .withColumn("pooled_hit_rate", r3(F.col("total_hits") / F.col("total_k")))
        .withColumn("target_label", target_label(F.col("target")))
    )


def coverage_profile(covered: DataFrame) -> DataFrame:
    """Mean unmappable rate by target, by country, by condition and overall."""
    return (
        covered.groupingSets([["target"], ["country"], ["condition"], []], "target", "country", "condition").agg(
            r3(F.avg("unmappable_rate")).alias("mean_unmappable_rate"),
            F.sum("n_asked").alias("total_asked"), F.sum("n_unmappable").alias("total_unmappable"),
            F.sum("n_duplicates_dropped").alias("total_dup_dropped"))
    )


def worst_coverage(covered: DataFrame, n: int = 8) -> DataFrame:
    return covered.orderBy(F.desc("unmappable_rate"), *KEYS).limit(n)


def lead_features(mappings: DataFrame, whole_word: bool = False) -> DataFrame:
    """First requested feature per cell and condition, and is it demographic?"""
    return (
        mappings.groupBy(*KEYS).agg(F.min_by("feature_label", "feature_rank").alias("rank0_label"))
        .withColumn("rank0_is_demographic", is_demographic(F.col("rank0_label"), whole_word))
    )


def lead_summary(leads: DataFrame) -> DataFrame:
    """Share of demographic lead features overall, by condition and by target."""
    return leads.groupingSets([["condition"], ["target"], []], "condition", "target").agg(
        F.count(F.lit(1)).alias("n_cells"),
        r3(share(F.col("rank0_is_demographic"))).alias("share_rank0_demographic"))


def extreme_cells(summary: DataFrame, min_k: int = 3, min_signal: float = 0.05) -> DataFrame:
    """Highest cost; lowest non-negative cost where the oracle clearly beats the majority."""
    full = summary.dropna(subset=["cost_of_imperfect", "k_mapped"]).where(F.col("k_mapped") >= min_k)
    signal = r4(F.col("oracle_acc") - F.col("majority_baseline"))
    out = [F.col(c) for c in KEYS] + [r4(F.col("cost_of_imperfect")).alias("cost")]
    high = full.orderBy(F.desc("cost_of_imperfect"), *KEYS).limit(1)
    low = full.where((signal >= min_signal) & (F.col("cost_of_imperfect") >= 0)) \
        .orderBy("cost_of_imperfect", *KEYS).limit(1)
    return high.select(F.lit("high_cost").alias("which"), *out).unionByName(
        low.select(F.lit("low_cost").alias("which"), *out))


def cell_reports(mappings: DataFrame, importances: DataFrame, cells: DataFrame | None = None,
                 k: int | None = None, at_least: int = 10) -> DataFrame:
    """Oracle top list, selected features in order, and hits, per cell and condition.

    ``cells`` (target, country, condition) restricts the report. The oracle list
    has max(k, 10) entries; hits are counted against the first k. Lists are as
    long as a cell's feature list.
    """
    cell = ["target", "country"]
    if cells is not None:
        mappings = mappings.join(cells.select(*KEYS), KEYS, "left_semi")
    first = (mappings.where(F.col("selected_code").isNotNull())
             .groupBy(*KEYS, "selected_code").agg(
                 F.min("feature_rank").alias("feature_rank"),
                 F.min_by("feature_label", "feature_rank").alias("feature_label")))
    counted = mappings.groupBy(*KEYS).agg(F.count_distinct("selected_code").alias("n_selected"))
    size = F.lit(k) if k is not None else F.col("n_selected")
    wanted = counted.withColumn("k", size.cast("bigint"))
    ranked = importance_rank(importances).withColumnRenamed("target_variable", "target")
    top = ranked.join(wanted, cell).where(F.col("rank") <= F.greatest("k", F.lit(at_least)))
    top_lists = top.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "feature_variable", r4(F.col("importance_mean")).alias("importance")))).alias("oracle_top"))
    flagged = flag_hits(first, top.where(F.col("rank") <= F.col("k")), KEYS)
    lists = flagged.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("feature_rank", "selected_code", "feature_label", "hit"))).alias("model_features"))
    return (
        wanted.join(top_lists, KEYS, "left").join(lists, KEYS, "left")
        .withColumn("hits", F.transform(F.filter("model_features", lambda s: s["hit"]), lambda s: s["selected_code"]))
        .select(*KEYS, "k", "oracle_top", "model_features", "hits")
    )


def full_report(summary: DataFrame, mappings: DataFrame, importances: DataFrame) -> dict[str, DataFrame]:
    """Every report table by name.

    Tables that several others read (summary, importances, rates, coverage, leads, extremes) are written once, so that the summary's
    joins run once and not per table; they have rows per cell. The rest stays lazy.
    """
    summary, importances = materialize(summary).df, materialize(importances).df
    pivot = condition_pivot(summary)
    rows = signal_gap(summary)
    rates = materialize(hit_rates(summary, mappings, importances)).df
    covered = materialize(coverage(mappings, KEYS)).df
    leads = materialize(lead_features(mappings)).df
    extremes = materialize(extreme_cells(summary)).df
    return {
        "headline_table": headline_table(summary),
        "headline_aggregate": headline_aggregate(summary),
        "per_target": per_target_rollup(summary),
        "condition_deltas": condition_deltas(pivot),
        "condition_effect": condition_effect(pivot),
        "signal_gap_rows": rows,
        "signal_gap_pearson": signal_gap_pearson(rows),
        "signal_gap_spearman": signal_gap_spearman(rows),
        "hit_rates": rates,
        "hit_rate_by_target": hit_rate_by_target(rates),
        "coverage": covered,
        "coverage_profile": coverage_profile(covered),
        "worst_coverage": worst_coverage(covered),
        "lead_features": leads,
        "lead_summary": lead_summary(leads),
        "extreme_cells": extremes,
        "extreme_reports": cell_reports(mappings, importances, extremes),
    }
