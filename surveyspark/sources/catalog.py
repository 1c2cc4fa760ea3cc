"""Survey scans, variable index, country maps and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions.text import first_text, strip

# The country column of each survey.
SURVEY_COUNTRY_COL = {
    "wvs": "B_COUNTRY",
    "afrobarometer": "COUNTRY",
    "arabbarometer": "COUNTRY",
    "asianbarometer": "country",
    "latinobarometer": "IDENPA",
    "ess_wave_10": "cntry",
    "ess_wave_11": "cntry",
}
EXCLUDED = "EXCLUDED"

VARIABLE_INFO = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("values", T.MapType(T.StringType(), T.StringType())),
])
METADATA_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), VARIABLE_INFO))


def scan_survey(spark: SparkSession, path: str, survey: str | None = None, fmt: str = "parquet",
                schema: T.StructType | str | None = None, country_col: str | None = None) -> DataFrame:
    """Read one survey; its country column is added as ``country`` text.

    Codes are text everywhere, whole numbers without a fraction part. A filter
    on the survey's own country column still reaches the files.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    column = country_col or SURVEY_COUNTRY_COL[survey]
    return df if column == "country" else df.withColumn("country", F.col(column).cast("string"))


def variables_from_nested(nested: DataFrame, column: str = "metadata") -> DataFrame:
    """Nested section → code → info maps to ``variables`` rows.

    One input row is one survey's metadata. ``ordinal`` keeps the reading order.
    """
    return (
        nested.select(F.posexplode(F.map_entries(column)).alias("_s", "section"))
        .select("_s", F.col("section.key").alias("section"), F.posexplode(F.map_entries("section.value")).alias("_v", "v"))
        .select(
            (F.col("_s").cast("bigint") * F.lit(1 << 32) + F.col("_v")).alias("ordinal"), "section",
            F.col("v.key").alias("var_code"), "v.value.question", "v.value.description", "v.value.values")
    )


def variable_index(variables: DataFrame, exclude: tuple[str, ...] = (EXCLUDED,)) -> DataFrame:
    """``(var_code, question_text)``: question or description, trimmed, not empty.

    A code listed in two sections keeps the later text.
    """
    text = strip(first_text(F.col("question"), F.col("description")))
    return (
        variables.where(~F.col("section").isin(*exclude))
        .select("ordinal", "var_code", text.alias("text"))
        .where(F.col("text") != "")
        .groupBy("var_code").agg(F.max_by("text", "ordinal").alias("question_text"))
    )


def question_texts(variables: DataFrame, codes: DataFrame) -> DataFrame:
    """Question, description or code of each asked ``var_code``; all sections count.

    The first section that lists a code wins. Unknown codes keep a NULL text.
    """
    first = variables.groupBy("var_code").agg(
        F.min_by(F.struct("question", "description"), "ordinal").alias("v"))
    text = first_text(F.col("v.question"), F.col("v.description"), F.col("var_code"))
    texts = first.select("var_code", strip(text).alias("question_text"))
    return codes.select("var_code").distinct().join(texts, "var_code", "left")


# Names shown in an error message.
SHOWN = 20


def missing_texts(texts: DataFrame) -> DataFrame:
    """All asked codes that the metadata do not have."""
    return texts.where(F.col("question_text").isNull()).select("var_code").distinct()


def require_texts(texts: DataFrame) -> DataFrame:
    """Fail when an asked code is not in the metadata; the message counts all and shows some."""
    missing = missing_texts(texts)
    n = missing.count()
    if n:
        raise KeyError(f"{n} codes not in the metadata (missing_texts lists all): {[r[0] for r in missing.orderBy('var_code').take(SHOWN)]}")
    return texts


def admin_variables(variables: DataFrame, country_col: str) -> DataFrame:
    """Codes that are never predictors: the excluded section and the country column."""
    spark = variables.sparkSession
    own = spark.range(1).select(F.lit(country_col).alias("var_code"))
    return (variables.where(F.col("section") == EXCLUDED).select("var_code")
            .unionByName(own).distinct())


def country_values(variables: DataFrame, country_col: str) -> DataFrame:
    """``(country_name, code, ordinal)`` from the country variable's value labels, in the first section that has it."""
    first = variables.where(F.col("var_code") == country_col).agg(
        F.min("ordinal").alias("ordinal"), F.min_by("values", "ordinal").alias("values"))
    return first.select("ordinal", F.explode("values").alias("code", "country_name"))


def country_map(values: DataFrame, data: DataFrame, country_col: str) -> DataFrame:
    """``(country_name, country_code)`` of the countries present in the data.

    When the data hold names rather than codes, names are matched ignoring case
    and names the metadata do not know stand for themselves. Works on the
    distinct country values.
    """
    found = (data.select(F.col(country_col).cast("string").alias("country_code"))
             .where(F.col("country_code").isNotNull()).distinct())
    labels = values.groupBy("country_name").agg(F.max_by("code", "ordinal").alias("code"))
    by_code = labels.withColumnRenamed("code", "country_code").join(found, "country_code", "left_semi") \
        .select("country_name", "country_code")
    if not by_code.isEmpty():
        return by_code
    lowered = found.groupBy(F.lower("country_code").alias("_low")).agg(
        F.max("country_code").alias("_any"), F.collect_set("country_code").alias("_all"))
    matched = (
        labels.withColumn("_low", F.lower("country_name")).join(lowered, "_low")
        .select("country_name", F.when(F.array_contains("_all", F.col("country_name")), F.col("country_name"))
                .otherwise(F.col("_any")).alias("country_code"))
    )
    rest = (found.join(matched, "country_code", "left_anti")
            .select(F.col("country_code").alias("country_name"), "country_code"))
    return matched.unionByName(rest)


def list_countries(country_codes: DataFrame) -> DataFrame:
    return country_codes.select("country_name", "country_code").distinct().orderBy("country_name")


def unknown_countries(requested: DataFrame, country_codes: DataFrame) -> DataFrame:
    """Requested names that the survey does not have."""
    return requested.select("country_name").distinct().join(country_codes, "country_name", "left_anti")


def require_countries(requested: DataFrame, country_codes: DataFrame) -> None:
    unknown = unknown_countries(requested, country_codes)
    n = unknown.count()
    if n:
        raise ValueError(f"{n} unknown countries (unknown_countries lists all): {[r[0] for r in unknown.orderBy('country_name').take(SHOWN)]}")


def stale_variables(index: DataFrame, cached: DataFrame, model: str) -> DataFrame:
    """Variables whose text has no up-to-date vector in the cache.

    ``cached`` is ``(var_code, text_md5, model)``.
    """
    wanted = index.withColumn("text_md5", F.md5(F.col("question_text").cast("binary"))) \
        .withColumn("model", F.lit(model))
    return wanted.join(cached, ["var_code", "text_md5", "model"], "left_anti")


def pending_cells(cells: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without a finished result."""
    return cells.join(done.select(*keys).distinct(), keys, "left_anti")
