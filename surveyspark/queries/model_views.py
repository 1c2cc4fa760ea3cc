"""SQL form of the cleaned survey, folds and naive Bayes tables (DuckDB side)."""

from __future__ import annotations

from surveyspark.queries.views import SURVEY_FEATURES, SURVEY_TARGETS, s4

NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
INT = r"'^\s*[+-]?\d+\s*$'"


def num(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, {NUM}) THEN try_cast(trim({col}) AS DOUBLE) END"


def integer(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, {INT}) THEN try_cast(trim({col}) AS BIGINT) END"


def code(col: str) -> str:
    """Cleaned number column as code text (all fixture codes are whole)."""
    return f"CASE WHEN {col} >= 0 THEN CAST(CAST({col} AS BIGINT) AS VARCHAR) END"


def share(col: str, view: str = "survey_wide") -> str:
    return f"(SELECT avg(CASE WHEN ({num(col)}) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {view})"


# q_mixed and q_status stay text, q_priority_code becomes a number; the share
# rule itself is checked by the clean_text query.
CLEAN = {"survey_clean": (["survey_wide"], f"""
    SELECT respondent_id, country, q_priority, q_status, q_segment, q_void,
           CASE WHEN {share('q_mixed')} > 0.5 THEN NULL ELSE q_mixed END AS q_mixed,
           {code(num('q_priority_code'))} AS q_priority_code, {code('q_balance')} AS q_balance,
           {code('q_price')} AS q_price, {code('q_month')} AS q_month
    FROM survey_wide""")}

LONG = {"survey_long": (["survey_clean"], " UNION ALL ".join(
    f"SELECT respondent_id, country, '{f}' AS var_code, {f} AS val FROM survey_clean"
    for f in SURVEY_FEATURES))}

TEXT_COLUMNS = ["q_mixed", "q_priority", "q_segment", "q_status", "q_void"]


def answers_view(view: str, columns: list[tuple[str, str]]) -> str:
    """``columns``: (name, 'text' or 'number'); number columns hold code text."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS target, country, respondent_id, CAST({c} AS VARCHAR) AS answer, "
        + (integer(c) if kind == "text" else f"CAST({c} AS BIGINT)")
        + f" AS as_int FROM {view} WHERE {c} IS NOT NULL" for c, kind in columns)


def class_views(answers: str, suffix: str = "") -> dict:
    """Class table over an answers view, rare classes removed."""
    return {
        f"class_counts{suffix}": ([answers], f"""
            SELECT target, country, answer, as_int, count(*) AS n,
                   bool_and(as_int IS NOT NULL) OVER (PARTITION BY target, country) AS all_int
            FROM {answers} GROUP BY target, country, answer, as_int"""),
        f"class_kept{suffix}": ([f"class_counts{suffix}"], f"""
            SELECT * FROM (
              SELECT target, country, answer, as_int, n, sum(n) OVER (PARTITION BY target, country,
                     CASE WHEN all_int THEN CAST(as_int AS VARCHAR) ELSE answer END) AS class_rows
              FROM class_counts{suffix}) WHERE class_rows >= 5"""),
        f"class_table{suffix}": ([f"class_kept{suffix}"], f"""
            SELECT target, country, answer, label, n,
                   dense_rank() OVER (PARTITION BY target, country ORDER BY CASE WHEN all_int THEN as_int END, label) - 1 AS y
            FROM (SELECT *, CASE WHEN all_int THEN CAST(as_int AS VARCHAR) ELSE answer END AS label
                  FROM (SELECT *, bool_and(as_int IS NOT NULL) OVER (PARTITION BY target, country) AS all_int
                        FROM class_kept{suffix}))"""),
        f"baseline{suffix}": ([f"class_table{suffix}"], f"""
            SELECT target, country, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_classes,
                   max(n)::DOUBLE / sum(n) AS majority_baseline
            FROM (SELECT target, country, y, sum(n) AS n FROM class_table{suffix} GROUP BY 1, 2, 3)
            GROUP BY 1, 2"""),
    }


def bayes_views(features: list[str]) -> dict:
    """Views from folds to log likelihoods; needs ``answers``, ``survey_long``."""
    return {
        "labeled": (["answers", "class_table"], """
            SELECT a.target, a.country, a.respondent_id, c.y FROM answers a
            JOIN class_table c ON a.target = c.target AND a.country = c.country AND a.answer = c.answer"""),
        "folds": (["labeled"], """
            SELECT *, CAST(rn % 5 AS INTEGER) AS fold, rn // 5 AS pos FROM (
              SELECT *, row_number() OVER (PARTITION BY target, country
                     ORDER BY md5('42|' || respondent_id), respondent_id) - 1 AS rn FROM labeled)"""),
        "prof": (["folds", "survey_long"], """
            SELECT f.target, f.country, f.fold, f.pos, f.respondent_id, f.y, l.var_code AS feature,
                   coalesce(l.val, '∅') AS val
            FROM folds f JOIN survey_long l ON f.respondent_id = l.respondent_id WHERE l.var_code <> f.target"""),
        "cnt": (["prof"], """
            SELECT target, country, feature, val, y, fold, count(*) AS n FROM prof GROUP BY ALL"""),
        "cls": (["folds"], "SELECT target, country, y, fold, count(*) AS n FROM folds GROUP BY ALL"),
        "all_folds": ([], "SELECT CAST(range AS INTEGER) AS fold FROM range(5)"),
        "train": (["cls", "all_folds"], """
            SELECT t.target, t.country, f.fold, t.y, CAST(t.n - coalesce(c.n, 0) AS BIGINT) AS n_y
            FROM (SELECT target, country, y, sum(n) AS n FROM cls GROUP BY 1, 2, 3) t CROSS JOIN all_folds f
            LEFT JOIN cls c ON c.target = t.target AND c.country = t.country AND c.y = t.y AND c.fold = f.fold"""),
        "prior": (["train"], """
            SELECT target, country, fold, y, n_y, ln((n_y + 1.0::DOUBLE)
                   / (sum(n_y) OVER w + count(*) OVER w)) AS prior
            FROM train WINDOW w AS (PARTITION BY target, country, fold)"""),
        "held": (["cls"], "SELECT target, country, fold, CAST(sum(n) AS BIGINT) AS n_test FROM cls GROUP BY 1, 2, 3"),
        "vals": (["cnt"], "SELECT target, country, feature, val, y, sum(n) AS n FROM cnt GROUP BY 1, 2, 3, 4, 5"),
        "trained": (["vals", "cnt", "train"], """
            SELECT v.target, v.country, t.fold, v.feature, v.val, t.y, t.n_y,
                   coalesce(s.n, 0) - coalesce(c.n, 0) AS m
            FROM (SELECT DISTINCT target, country, feature, val FROM vals) v
            JOIN train t ON t.target = v.target AND t.country = v.country
            LEFT JOIN vals s ON s.target = v.target AND s.country = v.country AND s.feature = v.feature
                 AND s.val = v.val AND s.y = t.y
            LEFT JOIN cnt c ON c.target = v.target AND c.country = v.country AND c.feature = v.feature
                 AND c.val = v.val AND c.y = t.y AND c.fold = t.fold"""),
        "options": (["trained"], """
            SELECT target, country, fold, feature, sum(seen) AS v FROM (
              SELECT target, country, fold, feature, val, CASE WHEN sum(m) > 0 THEN 1 ELSE 0 END AS seen
              FROM trained GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"""),
        "ll": (["trained", "options"], """
            SELECT t.target, t.country, t.fold, t.feature, t.val, t.y,
                   ln((t.m + 1.0::DOUBLE) / (t.n_y + o.v)) AS ll
            FROM trained t JOIN options o ON o.target = t.target AND o.country = t.country
                 AND o.fold = t.fold AND o.feature = t.feature"""),
        "pool": (["cnt"], "SELECT DISTINCT target, country, feature FROM cnt WHERE val <> '∅'"),
        # score of every class with all features but one left out is total - own
        "term": (["prof", "ll"], """
            SELECT p.target, p.country, p.fold, p.pos, p.respondent_id, p.y AS truth, p.feature, p.val, l.y AS c, l.ll
            FROM prof p JOIN ll l ON l.target = p.target AND l.country = p.country AND l.fold = p.fold
                 AND l.feature = p.feature AND l.val = p.val"""),
        "total": (["term", "prior"], """
            SELECT t.target, t.country, t.fold, t.pos, t.respondent_id, t.truth, t.c, sum(t.ll) + any_value(p.prior) AS s
            FROM term t JOIN prior p ON p.target = t.target AND p.country = t.country AND p.fold = t.fold AND p.y = t.c
            GROUP BY 1, 2, 3, 4, 5, 6, 7"""),
        "pred": (["total"], f"""
            SELECT target, country, fold, respondent_id, truth AS y, arg_max(c, {_key('s')}) AS pred
            FROM total GROUP BY 1, 2, 3, 4, 5"""),
        "acc": (["pred"], """
            SELECT target, country, fold, count(*) AS n_test, count(*) FILTER (pred = y) AS n_right,
                   count(*) FILTER (pred = y)::DOUBLE / count(*) AS accuracy FROM pred GROUP BY 1, 2, 3"""),
        "rest": (["term", "total"], """
            SELECT t.target, t.country, t.fold, t.pos, t.respondent_id, t.truth, t.feature, t.val, t.c, o.s - t.ll AS r
            FROM term t JOIN total o ON o.target = t.target AND o.country = t.country
                 AND o.respondent_id = t.respondent_id AND o.c = t.c"""),
        # exact mean over all permutations
        "swap": (["rest", "ll"], f"""
            SELECT r.target, r.country, r.fold, r.feature, r.respondent_id, r.truth, r.val, l.val AS new,
                   arg_max(r.c, {_key('r.r + l.ll')}) AS pred
            FROM rest r JOIN ll l ON l.target = r.target AND l.country = r.country AND l.fold = r.fold
                 AND l.feature = r.feature AND l.y = r.c GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""),
        "given": (["cnt"], """
            SELECT target, country, fold, feature, val AS new, sum(n) AS n_given FROM cnt GROUP BY 1, 2, 3, 4, 5"""),
        "drop_exact": (["swap", "given", "held", "pool"], """
            SELECT p.target, p.country, p.feature, h.fold,
                   coalesce(x.hits::DOUBLE / h.n_test - x.pairs::DOUBLE / (h.n_test * h.n_test), 0.0) AS drop_
            FROM pool p JOIN held h ON h.target = p.target AND h.country = p.country
            LEFT JOIN (
              SELECT s.target, s.country, s.fold, s.feature, count(*) FILTER (s.new = s.val) AS hits,
                     sum(coalesce(g.n_given, 0)) AS pairs
              FROM swap s LEFT JOIN given g ON g.target = s.target AND g.country = s.country
                   AND g.fold = s.fold AND g.feature = s.feature AND g.new = s.new
              WHERE s.pred = s.truth GROUP BY 1, 2, 3, 4) x
              ON x.target = p.target AND x.country = p.country AND x.fold = h.fold AND x.feature = p.feature"""),
        # ten seeded permutations of the rows of each fold
        "donor": (["folds"], """
            SELECT target, country, fold, rep, respondent_id AS donor_id, row_number() OVER (
                   PARTITION BY target, country, fold, rep
                   ORDER BY md5('42|' || rep || '|' || respondent_id), respondent_id) - 1 AS pos
            FROM folds CROSS JOIN (SELECT CAST(range AS INTEGER) AS rep FROM range(10))"""),
        "pair": (["donor", "folds", "prof"], """
            SELECT f.target, f.country, f.fold, d.rep, f.respondent_id, p.feature, p.val AS new
            FROM donor d JOIN folds f ON f.target = d.target AND f.country = d.country AND f.fold = d.fold AND f.pos = d.pos
            JOIN prof p ON p.target = d.target AND p.country = d.country AND p.respondent_id = d.donor_id"""),
        "drop_sampled": (["swap", "pair", "held", "pool"], """
            SELECT p.target, p.country, p.feature, h.fold,
                   coalesce(x.hits::DOUBLE / h.n_test, 0.0) - coalesce(z.after::DOUBLE / (h.n_test * 10), 0.0) AS drop_
            FROM pool p JOIN held h ON h.target = p.target AND h.country = p.country
            LEFT JOIN (SELECT target, country, fold, feature, count(*) AS hits FROM swap
                       WHERE pred = truth AND new = val GROUP BY 1, 2, 3, 4) x
              ON x.target = p.target AND x.country = p.country AND x.fold = h.fold AND x.feature = p.feature
            LEFT JOIN (SELECT q.target, q.country, q.fold, q.feature, count(*) AS after
                       FROM pair q JOIN swap s ON s.target = q.target AND s.country = q.country
                         AND s.respondent_id = q.respondent_id AND s.feature = q.feature AND s.new = q.new
                       WHERE s.pred = s.truth GROUP BY 1, 2, 3, 4) z
              ON z.target = p.target AND z.country = p.country AND z.fold = h.fold AND z.feature = p.feature"""),
        **{f"imp_{kind}": ([f"drop_{kind}", "baseline"], f"""
            SELECT d.target AS target_variable, d.country, d.feature AS feature_variable, avg(drop_) AS importance_mean,
                   stddev_pop(drop_) AS importance_std, {s4('any_value(b.majority_baseline)')} AS majority_baseline
            FROM drop_{kind} d JOIN baseline b ON b.target = d.target AND b.country = d.country
            GROUP BY 1, 2, 3""") for kind in ("exact", "sampled")},
    }


def _key(score: str) -> str:
    """Sort key of a class: score at nine decimals, then the later class."""
    c = "r.c" if score.startswith("r.") else "c"
    return f"CAST(floor(({score}) * 1e9::DOUBLE + 0.5::DOUBLE) AS HUGEINT) * 1000 + {c}"


def model_book(targets: list[str] = SURVEY_TARGETS) -> dict:
    """All views of the survey model for the given targets."""
    kinds = [(t, "text") for t in targets]
    return {**CLEAN, **LONG, "answers": (["survey_clean"], answers_view("survey_clean", kinds)),
            **class_views("answers"), **bayes_views(SURVEY_FEATURES)}
