"""Survey-shaped views over the given tables: Spark form and SQL form.

Both forms use whole tables. Every registered query starts from these views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions.numbers import half_up, r4, r6
from surveyspark.functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- survey ----------------------------------------------------------------

SURVEY_ID, SURVEY_COUNTRY = "respondent_id", "country"
SURVEY_ADMIN = ["respondent_id", "region", "country_code", "country"]
SURVEY_TARGETS = ["q_priority", "q_status", "q_segment"]
SURVEY_FEATURES = ["q_balance", "q_mixed", "q_month", "q_price", "q_priority",
                   "q_priority_code", "q_segment", "q_status", "q_void"]


def survey_wide(spark, sf_dir) -> DataFrame:
    """One respondent per order."""
    key = F.col("o_orderkey")
    month = F.month("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("respondent_id"),
            F.col("n_name").alias("country"),
            F.col("n_nationkey").cast("string").alias("country_code"),
            F.col("r_name").alias("region"),
            F.col("o_orderpriority").alias("q_priority"),
            F.substring("o_orderpriority", 1, 1).alias("q_priority_code"),
            F.col("o_orderstatus").alias("q_status"),
            F.col("c_mktsegment").alias("q_segment"),
            F.floor(F.col("c_acctbal") / 1000).cast("double").alias("q_balance"),
            F.floor(F.col("o_totalprice") / 50000).cast("double").alias("q_price"),
            month.alias("q_month"),
            F.when(key % 2 == 0, month.cast("string")).otherwise(F.col("o_orderstatus")).alias("q_mixed"),
            F.lit(None).cast("string").alias("q_void"),
        )
    )


def survey_small(spark, sf_dir) -> DataFrame:
    """Second survey: rated documents, few rows in some countries."""
    return (
        table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
        .select(F.col("doc_id").alias("respondent_id"), F.col("lang").alias("country"),
                "quality", "toxic", "source",
                F.floor(F.col("n_chars") / 500).cast("double").alias("length_band"))
    )


# --- variables -------------------------------------------------------------

def variables(spark, sf_dir) -> DataFrame:
    """Variable metadata from documents; rated ones appear in a second section."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    plain = docs.select(
        (doc * 2).alias("ordinal"),
        F.when(F.col("source") == "src19", "EXCLUDED").otherwise(F.upper("source")).alias("section"),
        F.concat(F.lit("V"), doc).alias("var_code"),
        F.when(doc % 11 == 0, "").otherwise(F.col("text")).alias("question"),
        F.when(doc % 22 == 0, "").otherwise(F.concat(F.lit("  "), "lang", F.lit(" item "), doc, F.lit(" ")))
        .alias("description"))
    rated = table(spark, sf_dir, "labels").select(
        (doc * 2 + 1).alias("ordinal"), F.lit("RATINGS").alias("section"),
        F.concat(F.lit("V"), doc).alias("var_code"),
        F.when(F.col("quality") == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" rated "), "toxic")).alias("question"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("quality "), "quality")).alias("description"))
    return plain.unionByName(rated)


# --- vectors ---------------------------------------------------------------

def variable_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("V"), "vec_id").alias("var_code"), F.col("embedding").alias("vector"))


def request_vectors(spark, sf_dir) -> DataFrame:
    """One request per vector, a partner vector as label+reasoning form."""
    emb = table(spark, sf_dir, "embeddings")
    partner = emb.select(F.col("vec_id").bitwiseXOR(F.lit(1)).alias("vec_id"), F.col("embedding").alias("partner"))
    target = emb.select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("target_vector"))
    return (
        emb.join(partner, "vec_id", "left")
        .withColumn("target_id", F.col("vec_id") % 5)
        .join(target, "target_id")
        .select(F.col("vec_id").alias("request_id"),
                F.concat(F.lit("V"), "target_id").alias("target"),
                F.col("embedding").alias("label_vector"),
                F.coalesce("partner", "embedding").alias("combined_vector"),
                "target_vector")
    )


# Letters that one kind of response writes as JSON escapes.
ESCAPED = [("\u00e9", "\\u00e9"), ("\u00fc", "\\u00FC"), ("\u00e4", "\\u00e4")]


# --- responses, mappings, importances, summary ------------------------------

def responses(spark, sf_dir) -> DataFrame:
    """Raw response texts from documents: whole text as it is, one feature per sentence.

    Twelve kinds: lists behind a fence, padded, with escaped letters, cut off, in single
    quotes, followed by words, by a second list or by words after the fence, an empty
    list, an object, and prose.
    """
    doc = F.col("doc_id")
    text = F.col("text")
    sentences = F.filter(F.transform(F.split(text, r"\."), strip), lambda s: s != "")
    body = F.to_json(F.transform(sentences, lambda s: F.struct(
        s.alias("feature"), F.coalesce("lang", F.lit("")).alias("reasoning"))))
    escaped = body
    for letter, code in ESCAPED:
        escaped = F.replace(escaped, F.lit(letter), F.lit(code))
    kinds = [
        F.concat(F.lit("```json\n"), body, F.lit("\n```")),
        F.concat(F.lit("  "), body, F.lit("\n")),
        text,
        F.lit("[]"),
        F.concat(body, F.lit(" and more")),
        F.to_json(F.struct(F.coalesce("source", F.lit("")).alias("feature"), text.alias("reasoning")), {"ignoreNullFields": "false"}),
        F.concat(F.lit("```\n\t"), body, F.lit("```\n")),
        F.concat(body, F.lit("\n"), body),
        F.replace(body, F.lit('"'), F.lit("'")),
        F.substring(body, F.lit(1), F.char_length(body) - 1 - F.char_length(body) % 7),
        escaped,
        F.concat(F.lit("```json\n"), body, F.lit("\n```\nThat is all.")),
    ]
    raw = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        raw = F.when(doc % len(kinds) == i, kind).otherwise(raw)
    return table(spark, sf_dir, "documents").select(
        doc.alias("response_id"),
        F.concat(F.lit("T"), doc % 5).alias("target"),
        F.when(doc % 2 == 1, F.concat(F.lit("C"), doc % 3)).alias("country"),
        raw.alias("raw_response"))


def choices(spark, sf_dir) -> DataFrame:
    """Choice answers from conversations: bare letters, phrases, whole turns as they are, alone or after a letter."""
    n = F.col("conv_id") + F.col("turn")
    letter = F.substring(F.lit("ABCDEZ"), ((n % 6) + 1).cast("int"), F.lit(1))
    kinds = [
        letter,
        F.concat(F.lit(" "), F.lower(letter), F.lit(" ")),
        F.lit("None of these"),
        F.concat(F.lit("Answer: "), letter),
        F.concat(letter, F.lit(" because A is off")),
        F.concat(F.lit("("), letter, F.lit(")")),
        F.lit(""),
        F.col("text"),
        F.concat(F.col("text"), F.lit('\n"'), letter, F.lit('"')),
        F.concat(F.lit("\u00e9"), letter, F.lit(" \u00fc"), F.lower(letter), F.lit("\u00df, 1. "), letter, F.lit(".")),
    ]
    raw = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        raw = F.when(F.col("conv_id") % len(kinds) == i, kind).otherwise(raw)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (1 + F.col("conv_id") % 7 % 5).cast("int").alias("n_candidates"), raw.alias("raw"))


# Feature labels of the mapping view, by position.
FEATURE_LABELS = ["age", "education level", "language use", "party choice", "household income",
                  "trust in others", "religious affiliation", "media habits", "urban or rural", "hobbies"]


def _event_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("target"),
        F.concat(F.lit("C"), F.col("user_id") % 5).alias("country"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id", "value")


def mappings(spark, sf_dir) -> DataFrame:
    """One requested feature per event, with the variable it was mapped to."""
    k = F.col("k")
    return _event_keys(spark, sf_dir).select(
        "target", "country",
        F.when(F.col("event_id") % 2 == 0, "unprompted").otherwise("country_provided").alias("condition"),
        F.get(F.array(*[F.lit(x) for x in FEATURE_LABELS]), (k % 10).cast("int")).alias("feature_label"),
        F.col("event_id").alias("feature_rank"),
        F.when(k >= 30, F.concat(F.lit("K"), k % 20)).alias("selected_code"))


def importances(spark, sf_dir) -> DataFrame:
    """Importance table over the same cells and codes as ``mappings``."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        _event_keys(spark, sf_dir)
        .groupBy(F.col("target").alias("target_variable"), "country",
                 F.concat(F.lit("K"), F.col("k") % 20).alias("feature_variable"))
        .agg(r6(F.sum(cents) / (F.count(F.lit(1)) * 100000.0)).alias("importance_mean"),
             r6(F.stddev_pop("value") / 1000.0).alias("importance_std"))
        .withColumn("majority_baseline", F.lit(0.5))
    )


def grid_summary(spark, sf_dir) -> DataFrame:
    """Grid result rows: market segment × nation × line status."""
    n = F.count(F.lit(1))

    def mean(col: str, scale: int, den: int):
        return F.sum(F.round(F.col(col) * scale).cast("bigint")) / (n * den)

    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    condition = F.when(F.col("l_linestatus") == "F", "unprompted").otherwise("country_provided")
    present = F.col("n") % 17 != 0
    return (
        joined.groupBy(F.col("c_mktsegment").alias("target"), F.col("n_name").alias("country"),
                       F.col("n_nationkey").cast("string").alias("country_code"), condition.alias("condition"))
        .agg(n.alias("n"),
             r4(0.36 + mean("l_tax", 100, 100)).alias("majority_baseline"),
             r4(0.41 + mean("l_discount", 100, 100)).alias("oracle_acc"),
             r4(F.stddev_pop("l_discount")).alias("oracle_std"),
             r4(mean("l_quantity", 1, 50) - 0.05).alias("m_acc"),
             r4(F.stddev_pop("l_quantity") / 50).alias("m_std"),
             r4(0.42 + mean("l_tax", 100, 100)).alias("random_acc"),
             r4(F.stddev_pop("l_tax")).alias("random_std"))
        .withColumn("model_acc", F.when(present, F.col("m_acc")))
        .withColumn("model_std", F.when(present, F.col("m_std")))
        .select(
            "target", "country", "country_code", "condition",
            (1 + F.col("n") % 9).alias("k_requested"),
            (1 + F.col("n") % 9 - F.col("n") % 3).alias("k_mapped"),
            "majority_baseline", "oracle_acc", "oracle_std", "model_acc", "model_std",
            "random_acc", "random_std",
            r4(F.col("oracle_acc") - F.col("model_acc")).alias("cost_of_imperfect"),
            r4(F.col("model_acc") - F.col("random_acc")).alias("value_over_random"),
            F.when(F.col("model_acc").isNull(), "no mapped features").alias("error"))
    )


def survey_requests(spark, sf_dir) -> DataFrame:
    """Requested features for the survey's cells, from events and nations."""
    e = F.col("event_id")
    country = F.col("user_id") % 25
    k = F.get_json_object("props", "$.k").cast("bigint")
    condition = F.floor(e / 3) % 2
    idx = ((country + 3 * condition + k % 4) % 12).cast("int")
    names = F.array(*[F.lit(f) for f in SURVEY_FEATURES])
    target = F.get(F.array(*[F.lit(t) for t in SURVEY_TARGETS]), (e % 3).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .withColumn("n_nationkey", country.cast("int"))
        .withColumn("_code", F.get(names, idx))
        .withColumn("target", target)
        .join(table(spark, sf_dir, "nation"), "n_nationkey")
        .select("target", F.col("n_name").alias("country"),
                F.when(condition == 0, "unprompted").otherwise("country_provided").alias("condition"),
                e.alias("feature_rank"),
                F.when(F.col("_code") != F.col("target"), F.col("_code")).alias("selected_code"))
    )


# --- SQL form --------------------------------------------------------------

def sql_half_up(x: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(floor(({x}) * {scale}.0::DOUBLE + 0.500001::DOUBLE) / {scale}.0::DOUBLE)"


def s3(x: str) -> str:
    return sql_half_up(x, 3)


def s4(x: str) -> str:
    return sql_half_up(x, 4)


def s6(x: str) -> str:
    return sql_half_up(x, 6)


def _pick(values: list[str], index: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({index} AS INTEGER) + 1)"


_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_SENTENCES = f"list_filter([trim(s, {_SPACES}) FOR s IN string_split(text, '.')], lambda s: s <> '')"
_BODY = (f"CAST(to_json([{{'feature': s, 'reasoning': coalesce(lang, '')}} FOR s IN {_SENTENCES}]) AS VARCHAR)")
_ESCAPED = "body"
for _letter, _code in ESCAPED:
    _ESCAPED = f"replace({_ESCAPED}, '{_letter}', '{_code}')"
_MONTH = "CAST(month(o_orderdate) AS VARCHAR)"


def _mean(col: str, scale: int, den: int) -> str:
    return f"(sum(CAST(round({col} * {scale}) AS BIGINT))::DOUBLE / (count(*) * {den}))"


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "survey_wide": ([], f"""
        SELECT o_orderkey AS respondent_id, n_name AS country, CAST(n_nationkey AS VARCHAR) AS country_code,
               r_name AS region, o_orderpriority AS q_priority,
               substr(o_orderpriority, 1, 1) AS q_priority_code, o_orderstatus AS q_status,
               c_mktsegment AS q_segment, floor(c_acctbal / 1000)::DOUBLE AS q_balance,
               floor(o_totalprice / 50000)::DOUBLE AS q_price, CAST(month(o_orderdate) AS INTEGER) AS q_month,
               CASE WHEN o_orderkey % 2 = 0 THEN {_MONTH} ELSE o_orderstatus END AS q_mixed,
               CAST(NULL AS VARCHAR) AS q_void
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "survey_small": ([], """
        SELECT d.doc_id AS respondent_id, lang AS country, quality, toxic, source,
               floor(n_chars / 500)::DOUBLE AS length_band
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "variables": ([], """
        SELECT doc_id * 2 AS ordinal, CASE WHEN source = 'src19' THEN 'EXCLUDED' ELSE upper(source) END AS section,
               'V' || doc_id AS var_code, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS question,
               CASE WHEN doc_id % 22 = 0 THEN '' ELSE '  ' || lang || ' item ' || doc_id || ' ' END AS description
        FROM documents
        UNION ALL
        SELECT doc_id * 2 + 1, 'RATINGS', 'V' || doc_id,
               CASE WHEN quality = 1 THEN NULL ELSE ' rated ' || toxic END,
               CASE WHEN toxic = 1 THEN '' ELSE 'quality ' || quality END
        FROM labels"""),
    "variable_vectors": ([], "SELECT 'V' || vec_id AS var_code, embedding::DOUBLE[] AS vector FROM embeddings"),
    "request_vectors": ([], """
        SELECT e.vec_id AS request_id, 'V' || (e.vec_id % 5) AS target, e.embedding::DOUBLE[] AS label_vector,
               coalesce(p.embedding, e.embedding)::DOUBLE[] AS combined_vector, t.embedding::DOUBLE[] AS target_vector
        FROM embeddings e LEFT JOIN embeddings p ON p.vec_id = xor(e.vec_id, 1)
             JOIN embeddings t ON t.vec_id = e.vec_id % 5"""),
    "responses": ([], f"""
        SELECT doc_id AS response_id, 'T' || (doc_id % 5) AS target,
               CASE WHEN doc_id % 2 = 1 THEN 'C' || (doc_id % 3) END AS country,
               CASE doc_id % 12
                 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                 WHEN 1 THEN '  ' || body || chr(10)
                 WHEN 2 THEN text
                 WHEN 3 THEN '[]'
                 WHEN 4 THEN body || ' and more'
                 WHEN 5 THEN CAST(to_json({{'feature': coalesce(source, ''), 'reasoning': text}}) AS VARCHAR)
                 WHEN 6 THEN '```' || chr(10) || chr(9) || body || '```' || chr(10)
                 WHEN 7 THEN body || chr(10) || body
                 WHEN 8 THEN replace(body, '"', chr(39))
                 WHEN 9 THEN substring(body, 1, length(body) - 1 - length(body) % 7)
                 WHEN 10 THEN {_ESCAPED}
                 ELSE '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'That is all.' END AS raw_response
        FROM (SELECT *, CASE WHEN text IS NOT NULL THEN {_BODY} END AS body FROM documents)"""),
    "choices": ([], """
        SELECT conv_id, turn, CAST(1 + conv_id % 7 % 5 AS INTEGER) AS n_candidates,
               CASE conv_id % 10 WHEN 0 THEN letter WHEN 1 THEN ' ' || lower(letter) || ' '
                 WHEN 2 THEN 'None of these' WHEN 3 THEN 'Answer: ' || letter
                 WHEN 4 THEN letter || ' because A is off' WHEN 5 THEN '(' || letter || ')'
                 WHEN 6 THEN '' WHEN 7 THEN text WHEN 8 THEN text || chr(10) || '"' || letter || '"'
                 ELSE '\u00e9' || letter || ' \u00fc' || lower(letter) || '\u00df, 1. ' || letter || '.' END AS raw
        FROM (SELECT *, substr('ABCDEZ', CAST((conv_id + turn) % 6 AS INTEGER) + 1, 1) AS letter FROM conversations)"""),
    "event_keys": ([], """
        SELECT event_type AS target, 'C' || (user_id % 5) AS country,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, value
        FROM events"""),
    "mappings": (["event_keys"], f"""
        SELECT target, country, CASE WHEN event_id % 2 = 0 THEN 'unprompted' ELSE 'country_provided' END AS condition,
               {_pick(FEATURE_LABELS, 'k % 10')} AS feature_label, event_id AS feature_rank,
               CASE WHEN k >= 30 THEN 'K' || (k % 20) END AS selected_code
        FROM event_keys"""),
    "importances": (["event_keys"], f"""
        SELECT target AS target_variable, country, 'K' || (k % 20) AS feature_variable,
               {s6("sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (count(*) * 100000.0::DOUBLE)")} AS importance_mean,
               {s6("stddev_pop(value) / 1000.0::DOUBLE")} AS importance_std, 0.5::DOUBLE AS majority_baseline
        FROM event_keys GROUP BY 1, 2, 3"""),
    "grid_raw": ([], f"""
        SELECT c_mktsegment AS target, n_name AS country, CAST(n_nationkey AS VARCHAR) AS country_code,
               CASE WHEN l_linestatus = 'F' THEN 'unprompted' ELSE 'country_provided' END AS condition,
               count(*) AS n,
               {s4("0.36::DOUBLE + " + _mean("l_tax", 100, 100))} AS majority_baseline,
               {s4("0.41::DOUBLE + " + _mean("l_discount", 100, 100))} AS oracle_acc,
               {s4("stddev_pop(l_discount)")} AS oracle_std,
               {s4(_mean("l_quantity", 1, 50) + " - 0.05::DOUBLE")} AS m_acc,
               {s4("stddev_pop(l_quantity) / 50")} AS m_std,
               {s4("0.42::DOUBLE + " + _mean("l_tax", 100, 100))} AS random_acc,
               {s4("stddev_pop(l_tax)")} AS random_std
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4"""),
    "grid_summary": (["grid_raw"], f"""
        SELECT target, country, country_code, condition, 1 + n % 9 AS k_requested,
               1 + n % 9 - n % 3 AS k_mapped, majority_baseline, oracle_acc, oracle_std, model_acc, model_std,
               random_acc, random_std, {s4("oracle_acc - model_acc")} AS cost_of_imperfect,
               {s4("model_acc - random_acc")} AS value_over_random,
               CASE WHEN model_acc IS NULL THEN 'no mapped features' END AS error
        FROM (SELECT *, CASE WHEN n % 17 <> 0 THEN m_acc END AS model_acc,
                     CASE WHEN n % 17 <> 0 THEN m_std END AS model_std FROM grid_raw)"""),
    "survey_requests": ([], f"""
        SELECT target, country, condition, feature_rank, CASE WHEN code <> target THEN code END AS selected_code
        FROM (SELECT {_pick(SURVEY_TARGETS, 'event_id % 3')} AS target, n_name AS country,
                CASE WHEN (event_id // 3) % 2 = 0 THEN 'unprompted' ELSE 'country_provided' END AS condition,
                event_id AS feature_rank,
                {_pick(SURVEY_FEATURES, "(user_id % 25 + 3 * ((event_id // 3) % 2) + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) % 12")} AS code
              FROM events JOIN nation ON n_nationkey = user_id % 25)"""),
}


def with_views(body: str, *names: str, extra: dict | None = None) -> str:
    """``body`` preceded by the named views, their own views first."""
    book = {**SQL_VIEWS, **(extra or {})}
    order: list[str] = []

    def add(name: str) -> None:
        for need in book[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({book[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"
