"""Folds, naive Bayes, permutation importance and feature-set comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions.numbers import r4, r6
from surveyspark.operators import bayes, evaluation, forest, importance
from surveyspark.operators.cleaning import clean_survey
from surveyspark.operators.encoding import class_distribution
from surveyspark.operators.mapping import selected_features
from surveyspark.operators.profiles import CELL, build_profiles
from surveyspark.operators.resampling import assign_folds, permuted, random_draws
from surveyspark.queries import views as V
from surveyspark.queries.model_views import model_book, num
from surveyspark.queries.views import s4, s6, with_views
from surveyspark.session import materialize

BOOK = model_book()


def clean(spark, sf):
    return clean_survey(V.survey_wide(spark, sf), V.SURVEY_ADMIN)


def profiles(spark, sf, targets=V.SURVEY_TARGETS):
    return build_profiles(clean(spark, sf), V.SURVEY_ID, V.SURVEY_COUNTRY, targets, V.SURVEY_FEATURES)


def model(spark, sf):
    return bayes.fit(profiles(spark, sf))


def kfold(spark, sf):
    return profiles(spark, sf).df.where(F.col("y").isNotNull()).select(
        *CELL, V.SURVEY_ID, "y", "fold", "pos")


def nb_model(spark, sf):
    ll = model(spark, sf).ll.df.select(*CELL, "fold", "feature", "val", F.posexplode("ll").alias("y", "ll"))
    return ll.select(*CELL, "fold", "feature", "val", F.col("y").cast("bigint").alias("y"), r6(F.col("ll")).alias("ll"))


def nb_predict(spark, sf):
    return bayes.predict_sets(model(spark, sf)).select(*CELL, V.SURVEY_ID, "fold", "y", "pred")


def fold_accuracy(spark, sf):
    return bayes.fold_accuracy(bayes.predict_sets(model(spark, sf)), CELL).select(
        *CELL, "fold", "n_test", "n_right", r6(F.col("accuracy")).alias("accuracy"))


def cv_summary(spark, sf):
    acc = bayes.fold_accuracy(bayes.predict_sets(model(spark, sf)), CELL)
    return evaluation.cv_summary(acc, CELL)


def permute_column(spark, sf):
    """The status column permuted inside the folds of the other targets, as often as importance does."""
    p = profiles(spark, sf, [t for t in V.SURVEY_TARGETS if t != "q_status"])
    at = [*CELL, "fold", "pos"]
    i = p.features.index("q_status")
    rows = p.df.where(F.col("y").isNotNull()).select(*at, V.SURVEY_ID, F.get("x", F.lit(i)).alias("val"))
    sizes = materialize(p.df.where(F.col("y").isNotNull()).groupBy(*CELL, "fold").agg(F.count(F.lit(1)).alias("n")))
    donors = permuted(rows, sizes, [*CELL, "fold"], V.SURVEY_ID, "val")
    return donors.select(*at, V.SURVEY_ID, "val", F.posexplode("donors").alias("rep", "permuted")).select(
        *at, V.SURVEY_ID, "rep", "val", "permuted")


def _rounded(imp):
    return imp.select("target_variable", "country", "feature_variable",
                      r6(F.col("importance_mean")).alias("importance_mean"),
                      r6(F.col("importance_std")).alias("importance_std"), "majority_baseline")


def permutation_importance(spark, sf):
    return _rounded(importance.permutation_importance(model(spark, sf)))


def permutation_importance_exact(spark, sf):
    return _rounded(importance.permutation_importance(model(spark, sf), n_repeats=None))


def top_features_described(spark, sf):
    """Top five per cell, described by the variable texts of the same name."""
    described = V.table(spark, sf, "documents").groupBy(
        F.get(F.array(*[F.lit(f) for f in V.SURVEY_FEATURES]), (F.col("doc_id") % 12).cast("int")).alias("var_code")
    ).agg(F.min_by("text", "doc_id").alias("description"))
    described = described.where(F.col("var_code").isNotNull())
    imp = _rounded(importance.permutation_importance(model(spark, sf), n_repeats=None))
    return importance.describe_top(imp, described).select(
        "target_variable", "country", "rank", "feature_variable", "importance_mean", "description")


def _cell_k(spark, sf):
    chosen = selected_features(V.mappings(spark, sf), [*CELL, "condition"])
    return chosen.groupBy(*CELL, "condition").agg((F.count(F.lit(1)) - F.lit(5)).alias("k"))


def oracle_topk(spark, sf):
    return importance.top_k(V.importances(spark, sf), _cell_k(spark, sf)).select(
        *CELL, "condition", "k", "rank", "feature_variable", "importance_mean")


def oracle_for_cell(spark, sf):
    cells = V.mappings(spark, sf).select(*CELL).distinct()
    return V.importances(spark, sf).withColumnRenamed("target_variable", "target").join(cells, CELL)


def _pool(spark, sf):
    return V.importances(spark, sf).select(
        F.col("target_variable").alias("target"), "country", F.col("feature_variable").alias("feature"))


def draws(spark, sf):
    return random_draws(_pool(spark, sf), _cell_k(spark, sf), CELL)


def random_baseline(spark, sf):
    """Draws scored by the mean importance of their features."""
    imp = V.importances(spark, sf).select(
        F.col("target_variable").alias("target"), "country", F.col("feature_variable").alias("feature"),
        F.round(F.col("importance_mean") * 1000000).cast("bigint").alias("micro"))
    scored = draws(spark, sf).join(imp, [*CELL, "feature"]).groupBy(*CELL, "condition", "draw").agg(
        r4(F.sum("micro") / (F.count(F.lit(1)) * 1000000.0)).alias("accuracy_mean"))
    return evaluation.random_baseline(scored, [*CELL, "condition"])


def _sets(spark, sf):
    return V.survey_requests(spark, sf).select(
        *CELL, F.concat(F.lit("ask_"), "condition").alias("set_id"), F.col("selected_code").alias("feature")) \
        .where(F.col("feature").isNotNull())


def eval_feature_sets(spark, sf):
    return evaluation.evaluate_feature_sets(model(spark, sf), _sets(spark, sf))


def compare_sets(spark, sf):
    m = model(spark, sf)
    imp = importance.permutation_importance(m, n_repeats=None).withColumn(
        "importance_mean", r6(F.col("importance_mean")))
    return evaluation.flatten(evaluation.compare(m, V.survey_requests(spark, sf), imp))


def class_distribution_query(spark, sf):
    return class_distribution(profiles(spark, sf).classes.df, CELL)


def forest_cv(spark, sf):
    """Cross-check of every cell with bagged trees: all features, the operator's own settings."""
    return forest.forest_grid(profiles(spark, sf))


QUERIES = {
    "kfold": kfold,
    "nb_model": nb_model,
    "nb_predict": nb_predict,
    "fold_accuracy": fold_accuracy,
    "cv_summary": cv_summary,
    "permute_column": permute_column,
    "permutation_importance": permutation_importance,
    "permutation_importance_exact": permutation_importance_exact,
    "top_features_described": top_features_described,
    "oracle_topk": oracle_topk,
    "oracle_for_cell": oracle_for_cell,
    "random_draws": draws,
    "random_baseline": random_baseline,
    "eval_feature_sets": eval_feature_sets,
    "compare_sets": compare_sets,
    "class_distribution": class_distribution_query,
    "forest_cv": forest_cv,
}

_CELL_K = """SELECT target, country, condition, count(DISTINCT selected_code) - 5 AS k FROM mappings
    WHERE selected_code IS NOT NULL GROUP BY 1, 2, 3"""
_DRAWS = """SELECT target, country, condition, draw, feature FROM (
    SELECT p.target, p.country, k.condition, k.k, d.draw, p.feature_variable AS feature,
           row_number() OVER (PARTITION BY p.target, p.country, k.condition, d.draw
             ORDER BY md5((d.draw + 42) || '|' || p.feature_variable), p.feature_variable) AS rn
    FROM (SELECT target_variable AS target, country, feature_variable FROM importances) p
    JOIN cell_k k ON k.target = p.target AND k.country = p.country
    CROSS JOIN (SELECT CAST(range AS INTEGER) AS draw FROM range(20)) d) WHERE rn <= k"""
_EXTRA = {"cell_k": (["mappings"], _CELL_K), "draws": (["importances", "cell_k"], _DRAWS)}

# feature sets: (target, country, set_id, feature), duplicates allowed
_ASK_SETS = """SELECT target, country, 'ask_' || condition AS set_id, selected_code AS feature
    FROM survey_requests WHERE selected_code IS NOT NULL"""


def _set_views(sets_view: str) -> dict:
    return {
        "usable": ([sets_view, "answers", "survey_long"], f"""
            SELECT DISTINCT s.target, s.country, s.set_id, s.feature FROM {sets_view} s
            JOIN (SELECT DISTINCT a.target, a.country, l.var_code AS feature FROM answers a
                  JOIN survey_long l ON l.respondent_id = a.respondent_id WHERE l.var_code <> a.target) c
              ON c.target = s.target AND c.country = s.country AND c.feature = s.feature"""),
        "set_total": (["usable", "term", "prior"], """
            SELECT t.target, t.country, u.set_id, t.fold, t.respondent_id, t.truth, t.c, sum(t.ll) + any_value(p.prior) AS s
            FROM term t JOIN usable u ON u.target = t.target AND u.country = t.country AND u.feature = t.feature
            JOIN prior p ON p.target = t.target AND p.country = t.country AND p.fold = t.fold AND p.y = t.c
            GROUP BY 1, 2, 3, 4, 5, 6, 7"""),
        "set_acc": (["set_total"], """
            SELECT target, country, set_id, fold, count(*) FILTER (pred = truth)::DOUBLE / count(*) AS accuracy FROM (
              SELECT target, country, set_id, fold, respondent_id, truth,
                     arg_max(c, CAST(floor(s * 1e9::DOUBLE + 0.5::DOUBLE) AS HUGEINT) * 1000 + c) AS pred
              FROM set_total GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4"""),
        "set_result": ([sets_view, "set_acc", "baseline", "usable", "answers"], f"""
            SELECT a.target, a.country, a.set_id, CASE WHEN e IS NULL THEN x.acc END AS accuracy_mean,
                   CASE WHEN e IS NULL THEN x.sd END AS accuracy_std,
                   CASE WHEN e IS NULL THEN {s4('a.majority_baseline')} END AS majority_baseline,
                   coalesce(a.n_features, 0) AS n_features, a.n_features_requested, a.n_samples, e AS error
            FROM (SELECT q.*, u.n_features,
                         coalesce(CASE WHEN u.n_features IS NULL THEN w.n ELSE b.n_samples END, 0) AS n_samples, b.majority_baseline,
                         CASE WHEN u.n_features IS NULL THEN 'no available features'
                              WHEN coalesce(b.n_classes, 0) < 2 THEN 'fewer than 2 classes' END AS e
                  FROM (SELECT target, country, set_id, count(feature) AS n_features_requested FROM {sets_view} GROUP BY 1, 2, 3) q
                  LEFT JOIN (SELECT target, country, set_id, count(*) AS n_features FROM usable GROUP BY 1, 2, 3) u
                    ON u.target = q.target AND u.country = q.country AND u.set_id = q.set_id
                  LEFT JOIN (SELECT target, country, count(*) AS n FROM answers GROUP BY 1, 2) w
                    ON w.target = q.target AND w.country = q.country
                  LEFT JOIN baseline b ON b.target = q.target AND b.country = q.country) a
            LEFT JOIN (SELECT target, country, set_id, {s4('avg(accuracy)')} AS acc, {s4('stddev_pop(accuracy)')} AS sd
                       FROM set_acc GROUP BY 1, 2, 3) x
              ON x.target = a.target AND x.country = a.country AND x.set_id = a.set_id"""),
    }


_COMPARE_SETS = """
    SELECT target, country, condition || '|model' AS set_id, selected_code AS feature FROM chosen
    UNION ALL
    SELECT target, country, condition || '|oracle', feature FROM (
      SELECT i.target, i.country, k.condition, k.k, i.feature, row_number() OVER (
             PARTITION BY i.target, i.country, k.condition ORDER BY i.imp DESC, i.feature) AS rn
      FROM imp6 i JOIN want k ON k.target = i.target AND k.country = i.country) WHERE rn <= k
    UNION ALL
    SELECT target, country, condition || '|random|' || draw, feature FROM (
      SELECT p.target, p.country, k.condition, k.k, d.draw, p.feature, row_number() OVER (
             PARTITION BY p.target, p.country, k.condition, d.draw
             ORDER BY md5((d.draw + 42) || '|' || p.feature), p.feature) AS rn
      FROM pool p JOIN want k ON k.target = p.target AND k.country = p.country
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS draw FROM range(20)) d) WHERE rn <= k"""
_COMPARE = {
    "chosen": (["survey_requests"], """SELECT DISTINCT target, country, condition, selected_code
        FROM survey_requests WHERE selected_code IS NOT NULL"""),
    "want": (["chosen"], "SELECT target, country, condition, count(*) AS k FROM chosen GROUP BY 1, 2, 3"),
    "imp6": (["imp_exact"], f"""SELECT target_variable AS target, country, feature_variable AS feature,
        {s6('importance_mean')} AS imp FROM imp_exact"""),
    "all_sets": (["chosen", "imp6", "want", "pool"], _COMPARE_SETS),
    **_set_views("all_sets"),
    "asked": (["survey_requests"], """SELECT target, country, condition, count(*) AS k_requested,
        count(DISTINCT selected_code) AS k_mapped FROM survey_requests GROUP BY 1, 2, 3"""),
    "part": (["set_result"], """SELECT *, string_split(set_id, '|')[1] AS condition,
        string_split(set_id, '|')[2] AS kind FROM set_result"""),
    "rand": (["part"], f"""SELECT target, country, condition, {s4('avg(accuracy_mean)')} AS random_acc,
        {s4('stddev_pop(accuracy_mean)')} AS random_std FROM part WHERE kind = 'random' GROUP BY 1, 2, 3"""),
}
def _tree_views() -> dict:
    """Bagged trees level by level; see ``operators.forest``."""
    cell = "target, country"
    same = lambda a, b, *names: " AND ".join(f"{a}.{n} = {b}.{n}" for n in ("target", "country", *names))
    out = {
        "bins": (["prof"], f"""
            SELECT {cell}, feature, val, CAST(CASE WHEN n <= {forest.BINS} THEN rn - 1 ELSE (rn - 1) * {forest.BINS} // n END AS INTEGER) AS bin FROM (
              SELECT *, row_number() OVER (PARTITION BY {cell}, feature ORDER BY CASE WHEN number THEN num END, val) AS rn FROM (
                SELECT *, bool_and(num IS NOT NULL) OVER w AS number, count(*) OVER w AS n FROM (
                  SELECT DISTINCT {cell}, feature, val, {num('val')} AS num FROM prof WHERE val <> '∅') WINDOW w AS (PARTITION BY {cell}, feature)))"""),
        "binned": (["prof", "bins"], f"""
            SELECT p.target, p.country, p.respondent_id, p.feature, coalesce(b.bin, -1) AS bin
            FROM prof p LEFT JOIN bins b ON {same('p', 'b', 'feature', 'val')}"""),
        "at0": (["folds"], f"""
            SELECT {cell}, respondent_id, fold, y, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, 1 AS node, true AS open
            FROM folds CROSS JOIN range(5) a(f) CROSS JOIN range({forest.TREES}) b(t)
            WHERE f = fold OR left(md5('42|b|' || t || '|' || respondent_id), 2) < '{forest.SHARE}'"""),
    }
    for d in range(forest.DEPTH):
        out[f"hist{d}"] = ([f"at{d}", "binned"], f"""
            SELECT a.target, a.country, f, t, node, feature, bin, y, count(*) AS n FROM at{d} a JOIN binned b ON {same('a', 'b', 'respondent_id')}
            WHERE open AND f <> fold AND left(md5('42|f|' || t || '|' || node || '|' || feature), 2) < '{forest.SHARE}' GROUP BY ALL""")
        key = f"{cell}, f, t, node, feature"
        out[f"side{d}"] = ([f"hist{d}"], f"""
            SELECT {key}, cut, y, coalesce(sum(n) FILTER (bin <= cut), 0)::BIGINT AS l, sum(n)::BIGINT AS a
            FROM hist{d} JOIN (SELECT DISTINCT {key}, bin AS cut FROM hist{d}) USING ({key}) GROUP BY {key}, cut, y""")
        out[f"split{d}"] = ([f"side{d}"], f"""
            SELECT {cell}, f, t, node, feature, cut FROM (
              SELECT *, row_number() OVER (PARTITION BY {cell}, f, t, node ORDER BY gain DESC, feature, cut) AS rn FROM (
                SELECT {key}, cut, sum(l * l)::DOUBLE / sum(l) + sum((a - l) * (a - l))::DOUBLE / sum(a - l) - sum(a * a)::DOUBLE / sum(a) AS gain
                FROM side{d} GROUP BY {key}, cut HAVING sum(l) >= {forest.MIN_ROWS} AND sum(a - l) >= {forest.MIN_ROWS})
              WHERE gain > {forest.LEAST_GAIN}) WHERE rn = 1""")
        out[f"at{d + 1}"] = ([f"at{d}", f"split{d}", "binned"], f"""
            SELECT a.target, a.country, a.respondent_id, a.fold, a.y, a.f, a.t, s.cut IS NOT NULL AS open,
                   CASE WHEN s.cut IS NULL THEN a.node ELSE a.node * 2 + CASE WHEN b.bin > s.cut THEN 1 ELSE 0 END END AS node
            FROM at{d} a LEFT JOIN split{d} s ON a.open AND {same('a', 's', 'f', 't', 'node')}
            LEFT JOIN binned b ON {same('a', 'b', 'respondent_id')} AND b.feature = s.feature""")
    last = f"at{forest.DEPTH}"
    out["voted"] = ([last], f"""
        SELECT {cell}, fold, respondent_id, y, arg_max(vote, n * 1000 + vote) AS pred FROM (
          SELECT x.target, x.country, x.fold, x.respondent_id, x.y, v.vote, count(*) AS n FROM {last} x
          LEFT JOIN (SELECT {cell}, f, t, node, arg_max(y, n * 1000 + y) AS vote FROM (
                       SELECT {cell}, f, t, node, y, count(*) AS n FROM {last} WHERE f <> fold GROUP BY ALL) GROUP BY ALL) v ON {same('x', 'v', 'f', 't', 'node')}
          WHERE x.f = x.fold GROUP BY ALL) GROUP BY {cell}, fold, respondent_id, y""")
    return out


_M = {**BOOK, **_EXTRA}
_IMP = "target_variable, country, feature_variable, {m} AS importance_mean, {s} AS importance_std, majority_baseline"
_IMP = _IMP.format(m=s6("importance_mean"), s=s6("importance_std"))

SQL = {
    "forest_cv": with_views("""SELECT target, country, fold, count(*) AS n_test, count(*) FILTER (pred = y) AS n_right,
        count(*) FILTER (pred = y)::DOUBLE / count(*) AS accuracy FROM voted GROUP BY 1, 2, 3""", "voted", extra={**_M, **_tree_views()}),
    "kfold": with_views("SELECT target, country, respondent_id, y, fold, pos FROM folds", "folds", extra=_M),
    "nb_model": with_views(f"SELECT target, country, fold, feature, val, y, {s6('ll')} AS ll FROM ll",
                           "ll", extra=_M),
    "nb_predict": with_views("SELECT target, country, respondent_id, fold, y, pred FROM pred", "pred", extra=_M),
    "fold_accuracy": with_views(f"SELECT target, country, fold, n_test, n_right, {s6('accuracy')} AS accuracy FROM acc",
                                "acc", extra=_M),
    "cv_summary": with_views(f"""SELECT target, country, {s4('avg(accuracy)')} AS accuracy_mean,
        {s4('stddev_pop(accuracy)')} AS accuracy_std, CAST(sum(n_test) AS BIGINT) AS n_samples FROM acc GROUP BY 1, 2""",
                             "acc", extra=_M),
    "permute_column": with_views("""
        SELECT f.target, f.country, f.fold, f.pos, f.respondent_id, d.rep, f.val, d.val AS permuted
        FROM (SELECT * FROM prof WHERE feature = 'q_status' AND target <> 'q_status') f
        JOIN (SELECT *, row_number() OVER (PARTITION BY target, country, fold, rep
                ORDER BY md5('42|' || rep || '|' || respondent_id), respondent_id) - 1 AS new_pos
              FROM prof CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range(10))
              WHERE feature = 'q_status' AND target <> 'q_status') d
          ON d.target = f.target AND d.country = f.country AND d.fold = f.fold AND d.new_pos = f.pos""", "prof", extra=_M),
    "permutation_importance": with_views(f"SELECT {_IMP} FROM imp_sampled", "imp_sampled", extra=_M),
    "permutation_importance_exact": with_views(f"SELECT {_IMP} FROM imp_exact", "imp_exact", extra=_M),
    "top_features_described": with_views(f"""
        SELECT target_variable, country, rank, feature_variable, importance_mean, substr(d.text, 1, 50) AS description FROM (
          SELECT *, row_number() OVER (PARTITION BY target_variable, country ORDER BY importance_mean DESC, feature_variable) AS rank
          FROM (SELECT {_IMP} FROM imp_exact)) i
        LEFT JOIN (SELECT {V._pick(V.SURVEY_FEATURES, 'doc_id % 12')} AS var_code, arg_min(text, doc_id) AS text
                   FROM documents GROUP BY 1) d ON d.var_code = i.feature_variable
        WHERE rank <= 5""", "imp_exact", extra=_M),
    "oracle_topk": with_views("""
        SELECT target, country, condition, k, rank, feature_variable, importance_mean FROM (
          SELECT i.target_variable AS target, i.country, c.condition, c.k, i.feature_variable, i.importance_mean,
                 row_number() OVER (PARTITION BY i.target_variable, i.country, c.condition
                   ORDER BY importance_mean DESC, feature_variable) AS rank
          FROM importances i JOIN cell_k c ON c.target = i.target_variable AND c.country = i.country)
        WHERE rank <= k""", "importances", "cell_k", extra=_EXTRA),
    "oracle_for_cell": with_views("""
        SELECT i.target_variable AS target, i.country, feature_variable, importance_mean, importance_std, majority_baseline
        FROM importances i WHERE EXISTS (SELECT 1 FROM mappings m WHERE m.target = i.target_variable AND m.country = i.country)""",
                                  "importances", "mappings"),
    "random_draws": with_views("SELECT * FROM draws", "draws", extra=_EXTRA),
    "random_baseline": with_views(f"""
        SELECT target, country, condition, {s4('avg(a)')} AS random_acc, {s4('stddev_pop(a)')} AS random_std, count(a) AS n_draws
        FROM (SELECT d.target, d.country, d.condition, d.draw,
                {s4("sum(CAST(round(importance_mean * 1000000) AS BIGINT))::DOUBLE / (count(*) * 1000000.0::DOUBLE)")} AS a
              FROM draws d JOIN importances i ON i.target_variable = d.target AND i.country = d.country
                AND i.feature_variable = d.feature GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "draws", "importances", extra=_EXTRA),
    "eval_feature_sets": with_views("SELECT * FROM set_result", "set_result", extra={
        **_M, "ask_sets": (["survey_requests"], _ASK_SETS), **_set_views("ask_sets")}),
    "compare_sets": with_views(f"""
        SELECT a.target, a.country, a.country AS country_code, a.condition, k_requested, k_mapped, o.majority_baseline,
               o.accuracy_mean AS oracle_acc, o.accuracy_std AS oracle_std, m.accuracy_mean AS model_acc,
               m.accuracy_std AS model_std, random_acc, random_std,
               {s4('o.accuracy_mean - m.accuracy_mean')} AS cost_of_imperfect,
               {s4('m.accuracy_mean - random_acc')} AS value_over_random,
               coalesce(CASE WHEN k_mapped = 0 THEN 'no mapped features' END, o.error, m.error) AS error
        FROM asked a
        LEFT JOIN (SELECT * FROM part WHERE kind = 'oracle') o ON o.target = a.target AND o.country = a.country AND o.condition = a.condition
        LEFT JOIN (SELECT * FROM part WHERE kind = 'model') m ON m.target = a.target AND m.country = a.country AND m.condition = a.condition
        LEFT JOIN rand r ON r.target = a.target AND r.country = a.country AND r.condition = a.condition""",
                               "asked", "part", "rand", extra={**_M, **_COMPARE}),
    "class_distribution": with_views("""SELECT target, country, y, label, CAST(sum(n) AS BIGINT) AS n
        FROM class_table GROUP BY 1, 2, 3, 4""", "class_table", extra=_M),
}
