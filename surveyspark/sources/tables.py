"""Result tables on disk: importances, mappings, comparisons, summaries, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the stored tables; reads never infer.
IMPORTANCE_SCHEMA = """target_variable string, country string, feature_variable string,
    importance_mean double, importance_std double, majority_baseline double"""
MAPPING_SCHEMA = """target string, country string, condition string, model string, feature_label string,
    feature_reasoning string, feature_rank bigint,
    candidates array<struct<var_code:string,question_text:string,similarity:double>>,
    top_match_code string, top_match_score double,
    disambig struct<selected_code:string,selected_text:string,selected_rank:int,raw_response:string>"""
SET_RESULT = """struct<accuracy_mean:double,accuracy_std:double,majority_baseline:double,
    n_features:bigint,n_features_requested:bigint,n_samples:bigint,error:string>"""
COMPARISON = f"""struct<target:string,country:string,k_requested:bigint,k_mapped:bigint,
    oracle:{SET_RESULT},model:{SET_RESULT},
    random:struct<accuracy_mean:double,accuracy_std:double,n_draws:bigint>,error:string>"""
EVALUATION_SCHEMA = f"""target string, country string, results map<string,{COMPARISON}>,
    errors array<struct<condition:string,error:string>>"""
SUMMARY_SCHEMA = """target string, country string, country_code string, condition string,
    k_requested bigint, k_mapped bigint, majority_baseline double, oracle_acc double, oracle_std double,
    model_acc double, model_std double, random_acc double, random_std double,
    cost_of_imperfect double, value_over_random double, error string"""
RESPONSE_SCHEMA = """target string, question_text string, country string, condition string, model string,
    raw_response string, features array<struct<feature:string,reasoning:string>>, n_features bigint,
    parse_error string, timestamp timestamp"""


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def write_importances(df: DataFrame, path: str) -> None:
    """Only the cells (target and country) in ``df`` are replaced."""
    (df.repartition("target_variable", "country").write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("target_variable", "country").parquet(path))


def read_importances(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """All features of all cells, or of one target (partition pruned)."""
    df = spark.read.schema(IMPORTANCE_SCHEMA).parquet(path).select(*_names(IMPORTANCE_SCHEMA))
    return df if target is None else df.where(F.col("target_variable") == target)


def read_importances_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table made elsewhere, in the same columns."""
    return spark.read.schema(IMPORTANCE_SCHEMA).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, keys: tuple[str, ...] = ("target", "country")) -> None:
    """Records by cell. Cells not in ``df`` keep their records; a NULL country is a cell of its own."""
    (df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("ignoreNullFields", False).partitionBy(*keys).json(path))


def read_json(spark: SparkSession, path: str, schema: str, whole_array: bool = False) -> DataFrame:
    """Records in the columns of ``schema``, whatever their order in the files."""
    return spark.read.schema(schema).option("multiLine", whole_array).json(path).select(*_names(schema))


def read_mappings(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """Mapping records, one per line; ``whole_array`` for files that are one JSON array."""
    return read_json(spark, path, MAPPING_SCHEMA, whole_array)


def read_responses(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    return read_json(spark, path, RESPONSE_SCHEMA, whole_array)


def write_evaluations(comparison: DataFrame, path: str) -> None:
    """Comparisons nested by cell: condition → result, with the error list."""
    body = F.struct("target", "country", "k_requested", "k_mapped", "oracle", "model", "random", "error")
    failed = F.collect_list(F.when(F.col("error").isNotNull(), F.struct("condition", "error")))
    nested = comparison.groupBy("target", "country").agg(
        F.map_from_entries(F.collect_list(F.struct("condition", body.alias("result")))).alias("results"),
        failed.alias("errors"))
    write_json(nested, path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Back to one nested comparison per cell and condition."""
    df = read_json(spark, path, EVALUATION_SCHEMA)
    return df.select(F.explode("results").alias("condition", "r")).select("condition", "r.*")


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows by cell. Cells not in ``df`` keep their rows."""
    (df.select(*_names(SUMMARY_SCHEMA)).repartition("target", "country").write.mode("overwrite").option("header", True)
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("target", "country").csv(path))


def read_summary(spark: SparkSession, path: str, partitioned: bool = True) -> DataFrame:
    """Summary rows with the derived ``cell`` name.

    Columns go by the names in the header; a file whose header differs fails.
    """
    fields = T.StructType.fromDDL(SUMMARY_SCHEMA).fields
    if partitioned:
        cell = ("target", "country")
        fields = [f for f in fields if f.name not in cell] + [f for f in fields if f.name in cell]
    df = spark.read.schema(T.StructType(fields)).option("header", True).option("enforceSchema", False).csv(path)
    return with_cell(df.select(*_names(SUMMARY_SCHEMA)))


def with_cell(summary: DataFrame) -> DataFrame:
    return summary.withColumn("cell", F.concat_ws("_", "target", "country"))


VECTOR_SCHEMA = "var_code string, text_md5 string, vector array<float>, model string"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, on whatever store it lies; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()] if store.exists(at) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a cache, rising; a write that was cut off has left no mark and doesn't count."""
    names = [n for n in _folders(spark, path) if n.startswith("version=")]
    jvm = spark.sparkContext._jvm
    done = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sorted(int(n.removeprefix("version=")) for n in names if done(n).getFileSystem(conf).exists(done(n)))


def _model_path(path: str, model: str) -> str:
    return f"{path}/model={model.encode().hex()}"


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of one model: var_code, text_md5, vector, model, as of its last finished version; none if there is none."""
    folder = _model_path(path, model)
    schema = T.StructType.fromDDL(VECTOR_SCHEMA)
    versions = _versions(spark, folder)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/version={versions[-1]}")


def merge_vectors(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after an update: fresh vectors replace those of the same code and model; of repeated fresh ones the last by text hash stays."""
    last = fresh.groupBy("var_code", "model").agg(F.max_by(F.struct("text_md5", "vector"), "text_md5").alias("_new"))
    last = last.select("var_code", "_new.text_md5", "_new.vector", "model")
    kept = cached.join(last.select("var_code", "model"), ["var_code", "model"], "left_anti")
    return kept.select(*_names(VECTOR_SCHEMA)).unionByName(last.select(*_names(VECTOR_SCHEMA)))


def upsert_vectors(spark: SparkSession, fresh: DataFrame, path: str, model: str, live: DataFrame | None = None) -> DataFrame:
    """Puts fresh vectors (var_code, text_md5, vector) of one model into the cache and returns its new state.

    The merged part of the model is written beside the old one and counts once it is finished, so readers see either state whole,
    a job that fails changes nothing, and other models are not touched. With ``live`` (var_code), vectors of other codes go.
    """
    merged = merge_vectors(read_vectors(spark, path, model), fresh.withColumn("model", F.lit(model)))
    if live is not None:
        merged = merged.join(live.select("var_code").distinct(), "var_code", "left_semi")
    folder = _model_path(path, model)
    names = [int(n.removeprefix("version=")) for n in _folders(spark, folder) if n.startswith("version=")]
    merged.select(*_names(VECTOR_SCHEMA)).write.parquet(f"{folder}/version={max(names, default=0) + 1}")
    return read_vectors(spark, path, model)


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.current_timestamp())
