"""Ceilings, entropy, mutual information, ranking agreement, annotators, regional cells and target choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions.numbers import r6
from surveyspark.operators import agreement, bayes, importance, screening, structure
from surveyspark.operators.encoding import target_answers
from surveyspark.operators.profiles import CELL, build_profiles
from surveyspark.queries import views as V
from surveyspark.queries.model_views import class_views, model_book
from surveyspark.queries.modelling import clean, model, profiles
from surveyspark.queries.views import s4, s6, with_views

MIN_ROWS = 600
N_SCREENED = 9
SECTIONS = 4


# --- views -------------------------------------------------------------------

def ratings(spark, sf):
    """Order lines as codings of an order by three annotators, some of them missing."""
    code = F.when(F.col("l_quantity") > 30, F.col("l_quantity").cast("bigint") % 5).otherwise(F.col("l_orderkey") % 5)
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.concat(F.lit("R"), F.col("l_linenumber") % 3).alias("rater"), F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_linenumber") < 7, F.get(F.array(*map(F.lit, agreement.CODES)), code.cast("int"))).alias("code"))


def candidate_importances(spark, sf):
    """Every code of the events as a candidate target, predicted by event types."""
    return V.importances(spark, sf).select(
        F.col("feature_variable").alias("target_variable"), "country", F.col("target_variable").alias("feature_variable"), "importance_mean")


def sections(profiles_):
    """Section of a candidate, by its number."""
    return profiles_.withColumn("section", F.concat(F.lit("S"), F.substring("target", 2, 9).cast("bigint") % SECTIONS))


# --- queries -----------------------------------------------------------------

def _ranked(m):
    return importance.permutation_importance(m, n_repeats=None).withColumn("importance_mean", r6(F.col("importance_mean")))


def _curve(spark, sf):
    m = model(spark, sf)
    return m, structure.ceiling_curve(m, _ranked(m))


def ceiling_curve(spark, sf):
    return _curve(spark, sf)[1]


def complexity(spark, sf):
    m, curve = _curve(spark, sf)
    return structure.complexity(curve, m.profiles.classes.df)


def complexity_calibration(spark, sf):
    return structure.complexity_calibration(V.survey_requests(spark, sf), complexity(spark, sf))


def target_entropy(spark, sf):
    return structure.target_entropy(profiles(spark, sf).classes.df)


def mutual_information(spark, sf):
    return structure.mutual_information(bayes.answer_counts(profiles(spark, sf)))


def rank_agreement(spark, sf):
    """Permutation importance and mutual information of the survey's cells."""
    m = model(spark, sf)
    return structure.rank_agreement(structure.as_features(_ranked(m)), structure.mutual_information(m.counts.df),
                                    "importance_mean", "mutual_information")


def country_pairs(spark, sf):
    return structure.country_pairs(V.importances(spark, sf))


def cross_country_stability(spark, sf):
    return structure.cross_country_stability(country_pairs(spark, sf))


def captured_importance(spark, sf):
    return structure.captured_importance(V.mappings(spark, sf), V.importances(spark, sf))


def cohen_kappa(spark, sf):
    return agreement.cohen_kappa(ratings(spark, sf))


def fleiss_kappa(spark, sf):
    return agreement.fleiss_kappa(ratings(spark, sf))


def fleiss_kappa_by_kind(spark, sf):
    return agreement.fleiss_kappa(ratings(spark, sf), ["kind"])


def annotation_sensitivity(spark, sf):
    return agreement.sensitivity(ratings(spark, sf))


def _cells(spark, sf):
    answers = target_answers(clean(spark, sf), V.SURVEY_TARGETS, [V.SURVEY_ID], V.SURVEY_COUNTRY)
    return screening.region_cells(answers, V.survey_wide(spark, sf).select("country", "region").distinct(), MIN_ROWS)


def region_cells(spark, sf):
    return _cells(spark, sf)


def region_folds(spark, sf):
    """Classes per fold of the cells that regional fallback leaves."""
    p = build_profiles(clean(spark, sf), V.SURVEY_ID, V.SURVEY_COUNTRY, V.SURVEY_TARGETS, V.SURVEY_FEATURES, cells=_cells(spark, sf))
    return p.df.where("y IS NOT NULL").groupBy(*CELL, "fold", "y").agg(F.count(F.lit(1)).alias("n"))


def target_profiles(spark, sf):
    imp = candidate_importances(spark, sf)
    stability = structure.cross_country_stability(structure.country_pairs(imp))
    return screening.target_profiles(imp, stability, imp.where("feature_variable = 'view'").select(F.col("feature_variable").alias("feature")))


def screened_targets(spark, sf):
    scored = screening.screening_score(sections(target_profiles(spark, sf)))
    return screening.stratified_draw(scored, N_SCREENED, "score").select("section", "target", "score", "place")


def drawn_targets(spark, sf):
    """A seeded draw of variables, by section."""
    variables = V.variables(spark, sf).select("section", F.col("var_code").alias("target"))
    return screening.stratified_draw(variables, 100).select("section", "target", "place")


def list_taxonomy(spark, sf):
    return screening.list_taxonomy(V.survey_requests(spark, sf))


def context_taxonomy(spark, sf):
    return screening.context_taxonomy(V.mappings(spark, sf), screening.list_taxonomy(V.mappings(spark, sf)))


QUERIES = {f.__name__: f for f in (
    ceiling_curve, complexity, complexity_calibration, target_entropy, mutual_information, rank_agreement, country_pairs,
    cross_country_stability, captured_importance, cohen_kappa, fleiss_kappa, fleiss_kappa_by_kind, annotation_sensitivity, region_cells,
    region_folds, target_profiles, screened_targets, drawn_targets, list_taxonomy, context_taxonomy)}


# --- SQL twins ---------------------------------------------------------------

def s_rank(keys: str, value: str) -> str:
    """Twice the average rank."""
    return f"(2 * rank() OVER (PARTITION BY {keys} ORDER BY {value}) + count(*) OVER (PARTITION BY {keys}, {value}) - 1)"


def s_corr(a: str, b: str) -> str:
    under = " * ".join(f"CAST(count(*) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)" for x in (a, b))
    return f"CASE WHEN {under} > 0 THEN CAST(count(*) * sum({a} * {b}) - sum({a}) * sum({b}) AS DOUBLE) / sqrt({under}) END"


_RANKED = f"""SELECT target_variable AS target, country, feature_variable AS feature, {s6('importance_mean')} AS imp,
    row_number() OVER (PARTITION BY target_variable, country ORDER BY {s6('importance_mean')} DESC, feature_variable) AS k FROM imp_exact"""
_CURVE = {
    "ranked": (["imp_exact"], _RANKED),
    "prefix": (["term", "ranked", "prior"], """
        SELECT t.target, t.country, t.fold, t.respondent_id, t.truth, t.c, r.k,
               sum(t.ll) OVER (PARTITION BY t.target, t.country, t.respondent_id, t.c ORDER BY r.k) + p.prior AS s
        FROM term t JOIN ranked r ON r.target = t.target AND r.country = t.country AND r.feature = t.feature
        JOIN prior p ON p.target = t.target AND p.country = t.country AND p.fold = t.fold AND p.y = t.c"""),
    "prefix_acc": (["prefix"], """
        SELECT target, country, fold, k, count(*) FILTER (pred = truth)::DOUBLE / count(*) AS accuracy FROM (
          SELECT target, country, fold, k, respondent_id, truth,
                 arg_max(c, CAST(floor(s * 1e9::DOUBLE + 0.5::DOUBLE) AS HUGEINT) * 1000 + c) AS pred
          FROM prefix GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4"""),
    "curve": (["prefix_acc", "ranked"], f"""
        SELECT a.target, a.country, a.k, r.feature, {s4('avg(accuracy)')} AS accuracy_mean, {s4('stddev_pop(accuracy)')} AS accuracy_std
        FROM prefix_acc a JOIN ranked r ON r.target = a.target AND r.country = a.country AND r.k = a.k GROUP BY 1, 2, 3, 4"""),
    "entropy": (["class_table"], f"""
        SELECT target, country, count(*) AS n_classes, {s6('abs(sum(-p * log2(p)))')} AS entropy
        FROM (SELECT target, country, y, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY target, country) AS p
              FROM class_table GROUP BY target, country, y) GROUP BY 1, 2"""),
    "complexity": (["curve", "entropy"], """
        SELECT c.target, c.country, any_value(e.n_classes) AS n_classes, any_value(e.entropy) AS entropy, max(c.k) AS n_features,
               arg_max(c.accuracy_mean, c.k) AS all_features, max(t.ceiling) AS ceiling,
               min(c.k) FILTER (CAST(round(c.accuracy_mean * 10000) AS BIGINT) * 10 >= CAST(round(t.ceiling * 10000) AS BIGINT) * 9) AS k90
        FROM curve c JOIN entropy e ON e.target = c.target AND e.country = c.country
        JOIN (SELECT target, country, max(accuracy_mean) AS ceiling FROM curve GROUP BY 1, 2) t ON t.target = c.target AND t.country = c.country
        GROUP BY 1, 2"""),
    "mi_sums": (["cnt"], """
        SELECT target, country, feature, max(n) AS n, sum(CASE WHEN g = 0 THEN n * ln(n) ELSE 0 END) AS joint,
               sum(CASE WHEN g = 1 THEN n * ln(n) ELSE 0 END) AS answers, sum(CASE WHEN g = 2 THEN n * ln(n) ELSE 0 END) AS classes,
               sum(CASE WHEN g = 3 THEN n * ln(n) ELSE 0 END) AS everything
        FROM (SELECT target, country, feature, CAST(sum(n) AS DOUBLE) AS n, grouping(val, y) AS g FROM cnt
              GROUP BY GROUPING SETS ((target, country, feature, val, y), (target, country, feature, val), (target, country, feature, y),
                                      (target, country, feature))) GROUP BY 1, 2, 3"""),
    "mi": (["mi_sums"], f"""
        SELECT target, country, feature, CAST(n AS BIGINT) AS n, {s6('i')} AS mutual_information,
               CASE WHEN h > 1e-12 THEN {s6('i / h')} END AS share
        FROM (SELECT *, greatest(0.0::DOUBLE, (joint - answers - classes + everything) / n) AS i, (everything - classes) / n AS h FROM mi_sums)"""),
}

_RATINGS = {
    "ratings": ([], f"""
        SELECT l_orderkey AS item, 'R' || (l_linenumber % 3) AS rater, l_returnflag AS kind, CASE WHEN l_linenumber < 7 THEN
               {V._pick(agreement.CODES, "(CASE WHEN l_quantity > 30 THEN CAST(l_quantity AS BIGINT) % 5 ELSE l_orderkey % 5 END)")} END AS code
        FROM lineitem"""),
    "coded": (["ratings"], "SELECT item, rater, min(code) AS code FROM ratings WHERE code IS NOT NULL GROUP BY 1, 2"),
    "code_pairs": (["coded"], """
        SELECT a.rater, b.rater AS other, a.code AS x, b.code AS y, count(*) AS n FROM coded a JOIN coded b ON a.item = b.item AND a.rater < b.rater
        GROUP BY 1, 2, 3, 4"""),
    "item_kind": (["ratings"], "SELECT item, min(kind) AS kind FROM ratings GROUP BY 1"),
}


def _fleiss(kind: str) -> str:
    by = "kind," if kind else ""
    of = "kind" if kind else "1"
    return f"""
        WITH c AS (SELECT {by} item, code, count(*) AS n FROM coded JOIN item_kind USING (item) GROUP BY ALL),
         m AS (SELECT {by} item, sum(n) AS m, sum(n * n) AS q FROM c GROUP BY ALL HAVING sum(n) > 1),
         p AS (SELECT {by} sum(n * n) AS products FROM (SELECT {by} code, sum(n) AS n FROM c WHERE item IN (SELECT item FROM m) GROUP BY ALL) GROUP BY ALL),
         o AS (SELECT {by} count(*) AS n_items, CAST(sum(m) AS BIGINT) AS n_ratings, avg((q - m)::DOUBLE / (m * (m - 1))) AS observed FROM m GROUP BY ALL)
        SELECT {'o.kind,' if kind else ''} n_items, n_ratings, {s4('observed')} AS agreement,
               CASE WHEN products::DOUBLE / (n_ratings * n_ratings) < 1 THEN
               {s4('(observed - products::DOUBLE / (n_ratings * n_ratings)) / (1 - products::DOUBLE / (n_ratings * n_ratings))')} END AS kappa
        FROM o JOIN p ON {'o.kind = p.kind' if kind else '1 = 1'}"""


def _pair_views(source: str, suffix: str = "") -> dict:
    """Correlations of country pairs over ``source`` (target, country, feature, v)."""
    return {
        f"paired{suffix}": ([source], f"""
            SELECT a.target, a.country, b.country AS other, a.v AS x, b.v AS z FROM {source} a
            JOIN {source} b ON a.target = b.target AND a.feature = b.feature AND a.country < b.country"""),
        f"pairs{suffix}": ([f"paired{suffix}", source], f"""
            SELECT t.target, t.country, t.other, coalesce(n_features, 0) AS n_features, spearman FROM (
              SELECT DISTINCT a.target, a.country, b.country AS other FROM {source} a JOIN {source} b ON a.target = b.target AND a.country < b.country) t
            LEFT JOIN (SELECT target, country, other, count(*) AS n_features, {s6(s_corr('ra', 'rb'))} AS spearman FROM (
              SELECT target, country, other, {s_rank('target, country, other', 'x')} AS ra, {s_rank('target, country, other', 'z')} AS rb FROM paired{suffix})
              GROUP BY 1, 2, 3) s ON s.target = t.target AND s.country = t.country AND s.other = t.other"""),
        f"stability{suffix}": ([f"pairs{suffix}"], f"""
            SELECT target, count(*) AS n_pairs, {s4('avg(spearman)')} AS mean_spearman, {s4('min(spearman)')} AS least, {s4('max(spearman)')} AS most
            FROM pairs{suffix} WHERE spearman IS NOT NULL GROUP BY 1"""),
    }


_PAIRS = {
    "imp_v": (["importances"], "SELECT target_variable AS target, country, feature_variable AS feature, importance_mean AS v FROM importances"),
    **_pair_views("imp_v"),
    "cand_v": (["importances"], "SELECT feature_variable AS target, country, target_variable AS feature, importance_mean AS v FROM importances"),
    **_pair_views("cand_v", "_c"),
    "profile": (["cand_v", "stability_c"], f"""
        SELECT c.target, c.n_countries, {s6('coalesce(m.m, 0)::DOUBLE / (c.n_countries * 1000000.0::DOUBLE)')} AS signal,
               CASE WHEN m.q > 0 THEN {s4('m.m::DOUBLE * m.m / m.q')} END AS diversity, {s4('1 - s.mean_spearman')} AS variation
        FROM (SELECT target, count(DISTINCT country) AS n_countries FROM cand_v GROUP BY 1) c
        LEFT JOIN (SELECT target, sum(m) AS m, sum(m::DOUBLE * m) AS q FROM (
                     SELECT target, feature, sum(greatest(0, CAST(round(v * 1000000) AS BIGINT))) AS m FROM cand_v WHERE feature <> 'view' GROUP BY 1, 2)
                   GROUP BY 1) m ON m.target = c.target
        LEFT JOIN stability_c s ON s.target = c.target"""),
}


def _draw(source: str, total: int, order: str) -> str:
    """Stratified draw from ``source`` (section, target, ...)."""
    return f"""
        SELECT r.* EXCLUDE (rn, n), rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {order}
               md5('42|' || section || '|' || target), target) AS rn, count(*) OVER (PARTITION BY section) AS n FROM {source}) r
        JOIN (SELECT section, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, section) <= total - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
              FROM (SELECT *, n * total // n_all AS whole, n * total % n_all AS rest FROM (
                SELECT section, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_all, least({total}, CAST(sum(count(*)) OVER () AS BIGINT)) AS total
                FROM {source} GROUP BY section))) q ON q.section = r.section WHERE rn <= quota"""


_REGION = {
    "regional": (["answers", "survey_wide"], f"""
        SELECT target, country, level, CASE level WHEN 'country' THEN country WHEN 'region' THEN region ELSE 'ALL' END AS place, n FROM (
          SELECT *, CASE WHEN n >= {MIN_ROWS} THEN 'country' WHEN sum(n) OVER (PARTITION BY target, region, n >= {MIN_ROWS}) >= {MIN_ROWS} THEN 'region'
                    ELSE 'all' END AS level
          FROM (SELECT target, country, count(*) AS n FROM answers GROUP BY 1, 2)
          JOIN (SELECT country, min(region) AS region FROM survey_wide GROUP BY 1) USING (country))"""),
    "answers_r": (["answers", "regional"], """
        SELECT a.target, r.place AS country, a.respondent_id, a.answer, a.as_int FROM answers a
        JOIN regional r ON r.target = a.target AND r.country = a.country"""),
    **class_views("answers_r", "_r"),
    "folds_r": (["answers_r", "class_table_r"], """
        SELECT *, CAST((row_number() OVER (PARTITION BY target, country ORDER BY md5('42|' || respondent_id), respondent_id) - 1) % 5 AS INTEGER) AS fold
        FROM (SELECT a.target, a.country, a.respondent_id, c.y FROM answers_r a JOIN class_table_r c
              ON a.target = c.target AND a.country = c.country AND a.answer = c.answer)"""),
}

_LIST_CLASS = """CASE WHEN n_a = 0 AND n_b = 0 THEN 'both empty' WHEN n_a = 0 OR n_b = 0 THEN 'one empty' WHEN a = b THEN 'same'
    WHEN n_s = n_a AND n_s = n_b THEN 'reordered' WHEN n_s = 0 THEN 'disjoint' ELSE 'partly changed' END"""


def _lists(source: str) -> dict:
    one = lambda condition: f"""(SELECT target, country, list(selected_code ORDER BY r, selected_code) AS l FROM (
        SELECT target, country, selected_code, min(feature_rank) AS r FROM {source}
        WHERE selected_code IS NOT NULL AND condition = '{condition}' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""  # noqa: E731
    return {"lists": ([source], f"""
        SELECT target, country, n_a AS n_unprompted, n_b AS n_provided, n_s AS n_shared,
               CASE WHEN n_a + n_b - n_s > 0 THEN {s4('n_s::DOUBLE / (n_a + n_b - n_s)')} END AS jaccard, {_LIST_CLASS} AS list_class
        FROM (SELECT *, len(a) AS n_a, len(b) AS n_b, len(list_intersect(a, b)) AS n_s FROM (
          SELECT c.target, c.country, coalesce(x.l, []) AS a, coalesce(z.l, []) AS b
          FROM (SELECT DISTINCT target, country FROM {source}) c
          LEFT JOIN {one('unprompted')} x ON x.target = c.target AND x.country = c.country
          LEFT JOIN {one('country_provided')} z ON z.target = c.target AND z.country = c.country))""")}


_M = {**model_book(), **_CURVE, **_RATINGS, **_PAIRS, **_REGION}
_MEASURES = " UNION ALL ".join(f"SELECT target, country, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM complexity" for m in ("k90", "entropy", "ceiling"))
_PLACE = " OR ".join(f"contains(lower(feature_label), '{w}')" for w in screening.PLACE_WORDS)

SQL = {
    "ceiling_curve": with_views("SELECT * FROM curve", "curve", extra=_M),
    "complexity": with_views("SELECT * FROM complexity", "complexity", extra=_M),
    "complexity_calibration": with_views(f"""
        SELECT condition, measure, count(*) AS n_cells,
               CASE WHEN stddev_pop(k) > 1e-9 AND stddev_pop(value) > 1e-9 THEN {s4('corr(k, value)')} END AS pearson, {s4(s_corr('rk', 'rv'))} AS spearman
        FROM (SELECT *, {s_rank('condition, measure', 'k')} AS rk, {s_rank('condition, measure', 'value')} AS rv FROM (
          SELECT r.condition, m.measure, r.k, m.value FROM (
            SELECT target, country, condition, count(DISTINCT selected_code) AS k FROM survey_requests WHERE selected_code IS NOT NULL GROUP BY 1, 2, 3) r
          JOIN ({_MEASURES}) m ON m.target = r.target AND m.country = r.country)) GROUP BY 1, 2""", "complexity", "survey_requests", extra=_M),
    "target_entropy": with_views("SELECT * FROM entropy", "entropy", extra=_M),
    "mutual_information": with_views("SELECT * FROM mi", "mi", extra=_M),
    "rank_agreement": with_views(f"""
        SELECT target, country, count(*) AS n_features, {s4(s_corr('ra', 'rb'))} AS spearman FROM (
          SELECT r.target, r.country, {s_rank('r.target, r.country', 'r.imp')} AS ra, {s_rank('r.target, r.country', 'm.mutual_information')} AS rb
          FROM ranked r JOIN mi m ON m.target = r.target AND m.country = r.country AND m.feature = r.feature) GROUP BY 1, 2""", "ranked", "mi", extra=_M),
    "country_pairs": with_views("SELECT * FROM pairs", "pairs", extra=_M),
    "cross_country_stability": with_views("SELECT * FROM stability", "stability", extra=_M),
    "captured_importance": with_views(f"""
        SELECT c.target, c.country, c.condition, c.k, c.n_unknown,
               CASE WHEN b.best IS NOT NULL THEN {s6('c.mine / 1000000.0::DOUBLE')} END AS selected_sum,
               {s6('b.best / 1000000.0::DOUBLE')} AS oracle_sum, CASE WHEN b.best > 0 THEN {s4('c.mine::DOUBLE / b.best')} END AS captured
        FROM (SELECT s.target, s.country, s.condition, count(*) AS k, count(*) FILTER (i.v IS NULL) AS n_unknown,
                     coalesce(sum(CAST(round(i.v * 1000000) AS BIGINT)), 0) AS mine
              FROM (SELECT DISTINCT target, country, condition, selected_code FROM mappings WHERE selected_code IS NOT NULL) s
              LEFT JOIN imp_v i ON i.target = s.target AND i.country = s.country AND i.feature = s.selected_code GROUP BY 1, 2, 3) c
        LEFT JOIN (SELECT target, country, condition, sum(CAST(round(v * 1000000) AS BIGINT)) AS best FROM (
                     SELECT i.target, i.country, q.condition, q.k, i.v, row_number() OVER (
                            PARTITION BY i.target, i.country, q.condition ORDER BY i.v DESC, i.feature) AS rn
                     FROM imp_v i JOIN (SELECT target, country, condition, count(DISTINCT selected_code) AS k FROM mappings
                                        WHERE selected_code IS NOT NULL GROUP BY 1, 2, 3) q ON q.target = i.target AND q.country = i.country)
                   WHERE rn <= k GROUP BY 1, 2, 3) b
          ON b.target = c.target AND b.country = c.country AND b.condition = c.condition""", "mappings", "imp_v", extra=_M),
    "cohen_kappa": with_views(f"""
        SELECT t.rater, t.other, n_items, {s4('same::DOUBLE / n_items')} AS agreement,
               CASE WHEN chance < 1 THEN {s4('(same::DOUBLE / n_items - chance) / (1 - chance)')} END AS kappa
        FROM (SELECT rater, other, CAST(sum(n) AS BIGINT) AS n_items, sum(CASE WHEN x = y THEN n ELSE 0 END) AS same FROM code_pairs GROUP BY 1, 2) t
        JOIN (SELECT a.rater, a.other, sum(a.n * coalesce(b.n, 0))::DOUBLE / max(a.total * a.total) AS chance
              FROM (SELECT rater, other, x, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rater, other) AS total FROM code_pairs GROUP BY 1, 2, 3) a
              LEFT JOIN (SELECT rater, other, y, sum(n) AS n FROM code_pairs GROUP BY 1, 2, 3) b ON b.rater = a.rater AND b.other = a.other AND b.y = a.x
              GROUP BY 1, 2) c ON c.rater = t.rater AND c.other = t.other""", "code_pairs", extra=_M),
    "fleiss_kappa": with_views(f"SELECT * FROM ({_fleiss('')})", "coded", "item_kind", extra=_M),
    "fleiss_kappa_by_kind": with_views(f"SELECT * FROM ({_fleiss('kind')})", "coded", "item_kind", extra=_M),
    "annotation_sensitivity": with_views(f"""
        SELECT rater, count(*) AS n, {s4("count(*) FILTER (code = 'correct')::DOUBLE / count(*)")} AS strict,
               {s4("count(*) FILTER (code IN ('correct', 'partial'))::DOUBLE / count(*)")} AS lenient,
               CASE WHEN count(*) FILTER (code = 'unmappable-vacuous') > 0 THEN
               {s4("count(*) FILTER (code = 'unmappable-insightful')::DOUBLE / count(*) FILTER (code = 'unmappable-vacuous')")} END AS insightful_to_vacuous
        FROM coded GROUP BY 1""", "coded", extra=_M),
    "region_cells": with_views("""SELECT target, country, level, place, CAST(sum(n) OVER (PARTITION BY target, level, place) AS BIGINT) AS n_rows
        FROM regional""", "regional", extra=_M),
    "region_folds": with_views("SELECT target, country, fold, y, count(*) AS n FROM folds_r GROUP BY 1, 2, 3, 4", "folds_r", extra=_M),
    "target_profiles": with_views("SELECT * FROM profile", "profile", extra=_M),
    "screened_targets": with_views(f"SELECT section, target, score, place FROM ({_draw('scored', N_SCREENED, 'score DESC NULLS LAST,')})", "scored", extra={
        **_M, "scored": (["profile"], f"""SELECT *, 'S' || (CAST(substr(target, 2) AS BIGINT) % {SECTIONS}) AS section,
            {s6('''(rank() OVER (ORDER BY signal NULLS FIRST) + rank() OVER (ORDER BY variation NULLS FIRST)) / (2.0::DOUBLE * count(*) OVER ())''')} AS score
            FROM profile""")}),
    "drawn_targets": with_views(f"SELECT section, target, place FROM ({_draw('named', 100, '')})", "named", extra={
        "named": (["variables"], "SELECT section, var_code AS target FROM variables")}),
    "list_taxonomy": with_views("SELECT * FROM lists", "lists", extra=_lists("survey_requests")),
    "context_taxonomy": with_views(f"""
        SELECT l.target, asks AS asks_place, n_cells, n_changed, CASE WHEN asks THEN 'context-aware' ELSE 'context-unaware' END || ' and '
               || CASE WHEN n_changed > 0.5 * n_cells THEN 'adaptive' ELSE 'rigid' END AS taxonomy
        FROM (SELECT target, count(*) AS n_cells, count(*) FILTER (list_class IN ('partly changed', 'disjoint', 'one empty')) AS n_changed
              FROM lists GROUP BY 1) l
        JOIN (SELECT target, coalesce(bool_or(condition = 'unprompted' AND ({_PLACE})), false) AS asks FROM mappings GROUP BY 1) m ON m.target = l.target""",
                                   "lists", "mappings", extra=_lists("mappings")),
}
