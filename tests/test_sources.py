import json

import pytest
from pyspark.sql import functions as F

from surveyspark.sources import catalog, tables


@pytest.fixture(scope="module")
def nested(spark):
    meta = {
        "DEMO": {"q1": {"question": " How old? ", "description": "age"}, "q2": {"question": "", "description": "\tsex\n"},
                 "q3": {"question": "", "description": ""}, "both": {"question": "first", "description": ""}},
        "EXCLUDED": {"id": {"question": "row id"}, "land": {"question": "country", "values": {"1": "Chile", "2": "Peru", "x": "Mars"}}},
        "ATT": {"both": {"question": "later", "description": ""}},
    }
    df = spark.createDataFrame([(json.dumps(meta),)], "raw string").select(
        F.from_json("raw", catalog.METADATA_SCHEMA).alias("metadata"))
    return catalog.variables_from_nested(df)


def test_variable_index(nested):
    got = {r["var_code"]: r["question_text"] for r in catalog.variable_index(nested).collect()}
    assert got == {"q1": "How old?", "q2": "sex", "both": "later"}


def test_question_text_takes_the_first_section_and_the_code(spark, nested):
    codes = spark.createDataFrame([("both",), ("id",), ("q3",), ("nope",)], "var_code string")
    got = {r["var_code"]: r["question_text"] for r in catalog.question_texts(nested, codes).collect()}
    assert got == {"both": "first", "id": "row id", "q3": "q3", "nope": None}
    with pytest.raises(KeyError, match="nope"):
        catalog.require_texts(catalog.question_texts(nested, codes))


def test_admin(nested):
    assert {r[0] for r in catalog.admin_variables(nested, "land").collect()} == {"id", "land"}


def test_country_map(spark, nested):
    values = catalog.country_values(nested, "land")
    by_code = spark.createDataFrame([(1,), (1,), (7,), (None,)], "land int")
    assert {tuple(r) for r in catalog.country_map(values, by_code, "land").collect()} == {("Chile", "1")}
    by_name = spark.createDataFrame([("chile",), ("Peru",), ("Fiji",)], "land string")
    got = catalog.country_map(values, by_name, "land")
    assert {tuple(r) for r in got.collect()} == {("Chile", "chile"), ("Peru", "Peru"), ("Fiji", "Fiji")}
    assert [r[0] for r in catalog.list_countries(got).collect()] == ["Chile", "Fiji", "Peru"]
    asked = spark.createDataFrame([("Peru",), ("Atlantis",)], "country_name string")
    with pytest.raises(ValueError, match="Atlantis"):
        catalog.require_countries(asked, got)


def test_stale_and_pending(spark, nested):
    index = catalog.variable_index(nested)
    cache = index.select("var_code", F.md5(F.col("question_text").cast("binary")).alias("text_md5"),
                         F.when(F.col("var_code") == "q2", "old").otherwise("m").alias("model"))
    cache = cache.where("var_code <> 'q1'")
    assert {r["var_code"] for r in catalog.stale_variables(index, cache, "m").collect()} == {"q1", "q2"}
    cells = spark.createDataFrame([("s", "q", "A"), ("t", "q", "A")], "survey string, target string, country string")
    assert catalog.pending_cells(cells, cells.limit(1), ["survey", "target", "country"]).count() == 1


def test_scan_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "survey")
    spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, B_COUNTRY int, q string").write.parquet(path)
    df = catalog.scan_survey(spark, path, "wvs")
    assert {r["country"] for r in df.collect()} == {"10", "20"}
    plan = df.where("B_COUNTRY = 10").select("q")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(B_COUNTRY), EqualTo(B_COUNTRY,10)]" in plan
    assert "ReadSchema: struct<B_COUNTRY:int,q:string>" in plan


def test_importance_partitions(spark, tmp_path):
    path = str(tmp_path / "imp")
    df = spark.createDataFrame([("q1", "A", "f", 0.1, 0.0, 0.5), ("q2", "A", "f", 0.2, 0.0, 0.5)], tables.IMPORTANCE_SCHEMA)
    tables.write_importances(df, path)
    tables.write_importances(df.where("target_variable = 'q1'").withColumn("importance_mean", F.lit(0.9)), path)
    assert {(r["target_variable"], r["importance_mean"]) for r in tables.read_importances(spark, path).collect()} == {("q1", 0.9), ("q2", 0.2)}
    one = tables.read_importances(spark, path, "q2")
    assert "PartitionFilters: [isnotnull(target_variable" in one._jdf.queryExecution().executedPlan().toString()


def test_whole_array_files(spark, tmp_path):
    path = tmp_path / "maps.json"
    path.write_text(json.dumps([{"target": "q", "country": None, "condition": "unprompted", "feature_label": "ä",
                                 "feature_rank": 0, "candidates": [{"var_code": "V", "question_text": "t", "similarity": 0.5}],
                                 "disambig": {"selected_code": "V"}}], indent=2, ensure_ascii=False), encoding="utf-8")
    row = tables.read_mappings(spark, str(path), whole_array=True).first()
    assert row["feature_label"] == "ä" and row["candidates"][0]["similarity"] == 0.5
    assert row["disambig"]["selected_code"] == "V" and row["top_match_code"] is None


def test_foreign_importances_csv(spark, tmp_path):
    path = tmp_path / "foreign.csv"
    path.write_text("target_variable,country,feature_variable,importance_mean,importance_std,majority_baseline\nq,A,f,0.25,0.0,0.5\n")
    assert tables.read_importances_csv(spark, str(path)).first()["importance_mean"] == 0.25


def test_vector_cache_swaps_whole_versions(spark, tmp_path):
    from surveyspark.sources import tables as tb
    path, schema = str(tmp_path / "vectors"), "var_code string, text_md5 string, vector array<float>"
    put = lambda rows, model, **more: tb.upsert_vectors(spark, spark.createDataFrame(rows, schema), path, model, **more)
    state = lambda model: {r.var_code: (r.text_md5, r.vector) for r in tb.read_vectors(spark, path, model).collect()}
    assert state("a/b") == {}
    put([("x", "1", [1.0]), ("y", "1", [2.0])], "a/b")
    put([("x", "9", [9.0])], "other")
    before = tb.read_vectors(spark, path, "a/b")
    put([("y", "2", [3.0]), ("y", "3", [4.0]), ("z", "1", [5.0])], "a/b")
    assert state("a/b") == {"x": ("1", [1.0]), "y": ("3", [4.0]), "z": ("1", [5.0])} and state("other") == {"x": ("9", [9.0])}
    assert {r.var_code for r in before.collect()} == {"x", "y"}  # who reads the old state sees it whole
    # a write that was cut off leaves a folder without mark
    cut = tmp_path / "vectors" / f"model={b'a/b'.hex()}" / "version=3"
    cut.mkdir()
    assert set(state("a/b")) == {"x", "y", "z"}
    put([], "a/b", live=spark.createDataFrame([("y",)], "var_code string"))
    assert set(state("a/b")) == {"y"}
