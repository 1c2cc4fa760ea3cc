import pytest
from pyspark.sql import functions as F

from surveyspark.operators.mapping import coverage
from surveyspark.plans import report
from surveyspark.sources.tables import SUMMARY_SCHEMA


def summary(spark, rows):
    cols = [f.strip().split()[0] for f in SUMMARY_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], SUMMARY_SCHEMA)


def cell(t, c, cond="unprompted", **kw):
    return {"target": t, "country": c, "condition": cond, **kw}


def test_pooled_rates_of_the_published_totals(spark):
    # hits and features per target, as published for a 5 × 5 × 2 grid
    published = {"Q164": (8, 62), "Q47": (3, 30), "Q199": (6, 66), "Q235": (2, 60), "Q57": (1, 50)}
    data = [(t, "A", "unprompted", k, h, h / k) for t, (h, k) in published.items()]
    rates = spark.createDataFrame(data, "target string, country string, condition string, k_mapped bigint, n_hits bigint, hit_rate double")
    got = {r["target"]: (r["pooled_hit_rate"], r["target_label"]) for r in report.hit_rate_by_target(rates).collect()}
    assert got["Q164"] == (0.129, "Importance of God") and got["Q57"][0] == 0.02
    assert sum(k for _, k in published.values()) == 268


def test_hit_rates(spark):
    s = summary(spark, [cell("q", "A", k_mapped=2), cell("q", "B", k_mapped=0), cell("q", "C", k_mapped=2)])
    maps = spark.createDataFrame([("q", "A", "unprompted", r, c, "age") for r, c in enumerate(["f2", None, "f9", "f2"])],
                                 "target string, country string, condition string, feature_rank bigint, selected_code string, feature_label string")
    imp = spark.createDataFrame([("q", "A", f"f{i}", 1.0 - i / 10) for i in range(1, 6)],
                                "target_variable string, country string, feature_variable string, importance_mean double")
    got = {r["country"]: (r["n_hits"], r["hit_rate"], r["hit_codes"]) for r in report.hit_rates(s, maps, imp).collect()}
    assert got == {"A": (1, 0.5, ["f2"]), "B": (0, None, []), "C": (0, None, [])}
    r = report.cell_reports(maps, imp).first()
    assert [x["feature_variable"] for x in r["oracle_top"]] == ["f1", "f2", "f3", "f4", "f5"]
    assert [x["selected_code"] for x in r["model_features"]] == ["f2", "f9"] and r["hits"] == ["f2"] and r["k"] == 2


def test_coverage_adds_up(spark):
    maps = spark.createDataFrame([("q", "A", "u", c) for c in ["a", "a", None, "b"]],
                                 "target string, country string, condition string, selected_code string")
    r = coverage(maps, report.KEYS).first()
    assert (r["n_asked"], r["n_unmappable"], r["n_duplicates_dropped"], r["n_usable"]) == (4, 1, 1, 2)
    assert r["unmappable_rate"] == 0.25
    profile = report.coverage_profile(coverage(maps, report.KEYS)).collect()
    assert len(profile) == 4 and {p["mean_unmappable_rate"] for p in profile} == {0.25}


def test_extremes_of_nothing(spark):
    assert report.extreme_cells(summary(spark, [cell("q", "A", k_mapped=1, cost_of_imperfect=0.2)])).count() == 0


def test_extreme_bounds(spark):
    s = summary(spark, [
        cell("q", "A", k_mapped=3, cost_of_imperfect=0.2, oracle_acc=0.6, majority_baseline=0.5),
        cell("q", "B", k_mapped=3, cost_of_imperfect=0.0, oracle_acc=0.55, majority_baseline=0.5),
        cell("q", "C", k_mapped=3, cost_of_imperfect=-0.1, oracle_acc=0.9, majority_baseline=0.5),
        cell("q", "D", k_mapped=2, cost_of_imperfect=0.9, oracle_acc=0.9, majority_baseline=0.5)])
    got = {r["which"]: r["country"] for r in report.extreme_cells(s).collect()}
    assert got == {"high_cost": "A", "low_cost": "B"}  # a signal of exactly 0.05 counts


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for i, c in enumerate("ABCDE"):
        for cond, shift in (("unprompted", 0.0), ("country_provided", 0.01 * (i - 1))):
            rows.append(cell("q", c, cond, k_requested=4, k_mapped=3 + i, majority_baseline=0.5, oracle_acc=0.6 + 0.01 * i,
                             model_acc=0.55 + shift, random_acc=0.5, cost_of_imperfect=round(0.05 + 0.01 * i - shift, 4),
                             value_over_random=round(0.05 + shift, 4)))
    rows.append(cell("q", "F", "unprompted", k_requested=0, k_mapped=0, error="no mapped features"))
    return summary(spark, rows)


def test_condition_effect(pairs):
    r = report.condition_effect(report.condition_pivot(pairs)).first()
    assert (r["n_cells"], r["mean_delta_model_acc"], r["median_delta_model_acc"], r["share_cp_beats_up"]) == (5, 0.01, 0.01, 0.6)


def test_correlations(pairs):
    rows = report.signal_gap(pairs).withColumn("gap", F.col("signal"))
    assert report.signal_gap_spearman(rows).first()["spearman"] == 1.0
    assert report.signal_gap_pearson(rows).first()["pearson"] == 1.0


def test_headline(pairs):
    r = report.headline_aggregate(pairs).first()
    assert r["n_cells_rows"] == 10 and r["share_oracle_beats_majority"] == 1.0
    assert report.headline_table(pairs).where("country = 'F'").first()["unmappable_rate"] is None
    assert report.per_target_rollup(pairs).first()["n_rows"] == 10


def test_leads(spark):
    maps = spark.createDataFrame([("q", "A", "u", 1, "hobbies"), ("q", "A", "u", 0, "language"), ("q", "B", "u", 0, "hobbies")],
                                 "target string, country string, condition string, feature_rank int, feature_label string")
    leads = report.lead_features(maps)
    assert {r["country"]: r["rank0_is_demographic"] for r in leads.collect()} == {"A": True, "B": False}
    assert {r["share_rank0_demographic"] for r in report.lead_summary(leads).collect()} == {0.5}


def test_full_report_names(spark, pairs):
    maps = spark.createDataFrame([], "target string, country string, condition string, feature_rank bigint, selected_code string, feature_label string")
    imp = spark.createDataFrame([], "target_variable string, country string, feature_variable string, importance_mean double")
    out = report.full_report(pairs, maps, imp)
    assert len(out) == 17 and out["hit_rates"].where("hit_rate is not null").count() == 0


def test_full_report_computes_the_summary_once(spark, pairs):
    maps = spark.createDataFrame([("q", "A", "unprompted", 0, "K1", "age")],
                                 "target string, country string, condition string, feature_rank bigint, selected_code string, feature_label string")
    imp = spark.createDataFrame([("q", "A", "K1", 0.5)], "target_variable string, country string, feature_variable string, importance_mean double")
    out = report.full_report(pairs.repartition(3), maps, imp)
    for df in out.values():  # the step that makes the summary is part of no table
        assert "RoundRobinPartitioning" not in df._jdf.queryExecution().executedPlan().toString()
