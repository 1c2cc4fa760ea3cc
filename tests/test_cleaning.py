import pytest
from pyspark.sql import functions as F

from surveyspark.operators import cleaning
from surveyspark.operators.encoding import class_distribution, class_table, label_codes, majority_baseline, target_answers
from surveyspark.operators.profiles import CELL

from conftest import rows


@pytest.fixture(scope="module")
def survey(spark):
    data = [
        (1, "A", -1.0, "1", "x", "1", None),
        (2, "A", float("nan"), "2", "y", "b", None),
        (3, "B", 0.0, "-9", None, "2", None),
        (4, "B", 3.0, "four", "x", "d", None),
    ]
    return spark.createDataFrame(data, "id int, land string, n double, t string, w string, half string, void string")


def test_missing_codes_and_mixed_columns(survey):
    out = cleaning.clean_survey(survey, ["id", "land"])
    types = dict(out.dtypes)
    assert types["t"] == "double" and types["w"] == "string"
    assert types["half"] == "string"  # a share of exactly one half stays text
    assert [tuple(r) for r in out.orderBy("id").select("n", "t").collect()] == [
        (None, 1.0), (None, 2.0), (0.0, None), (3.0, None)]


def test_number_shapes(spark):
    from surveyspark.functions.numbers import to_integer, to_number

    texts = ["1", " 2.5 ", "-3", "1e2", ".5", "1d", "inf", "NaN", "0x10", "", None, "1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, -3.0, 100.0, 0.5] + [None] * 7
    assert [r[0] for r in df.select(to_integer(F.col("t"))).collect()][:3] == [1, None, -3]


def test_filters_and_errors(survey):
    assert cleaning.country_rows(survey, "land", "B").count() == 2
    with pytest.raises(ValueError, match="A.*B"):
        cleaning.require_rows(cleaning.country_rows(survey, "land", "Z"), survey, "land", "Z")
    assert cleaning.with_target(survey, "w").count() == 3
    assert cleaning.feature_columns(survey, ["id"], "n", "land") == ["t", "w", "half", "void"]


def test_long_form_drops_empty_features(spark, survey):
    long = cleaning.to_long(cleaning.clean_survey(survey, ["id", "land"]), ["id", "land"], ["n", "t", "w", "void"])
    admin = spark.createDataFrame([("t",)], "var_code string")
    pool = cleaning.pool_from_long(long, admin, ["land"], "none")
    assert rows(pool.select("land", "var_code", "n_answers")) == [
        ("A", "w", 2), ("B", "n", 2), ("B", "w", 1)]


def test_first_answer_wins(spark):
    df = spark.createDataFrame([(1, "q", "b", 2), (1, "q", "a", 1), (2, "q", None, 1), (2, "q", "z", 2)],
                               "id int, var_code string, val string, pos int")
    assert {r["id"]: r["val"] for r in cleaning.first_answers(df, ["id"], "pos").collect()}[1] == "a"


def answers(spark, values, numeric=False):
    kind = "double" if numeric else "string"
    df = spark.createDataFrame([(i, "C", v) for i, v in enumerate(values)], f"id int, country string, q {kind}")
    return target_answers(df, ["q"], ["id"], "country")


def classes(spark, values, numeric=False):
    table = class_distribution(class_table(answers(spark, values, numeric), CELL), CELL)
    return [(r["label"], r["n"]) for r in table.orderBy("y").collect()]


def test_rare_classes(spark):
    assert classes(spark, ["a"] * 5 + ["b"] * 4 + ["c"] * 6) == [("a", 5), ("c", 6)]


def test_integer_order_and_fallback(spark):
    assert classes(spark, ["10"] * 5 + ["9"] * 5) == [("9", 5), ("10", 5)]
    assert classes(spark, ["10"] * 5 + ["9"] * 5 + ["x"] * 5) == [("10", 5), ("9", 5), ("x", 5)]
    # the text label is rare, so the rest counts as integers again
    assert classes(spark, ["10"] * 5 + ["9"] * 5 + ["x"]) == [("9", 5), ("10", 5)]
    # whole parts of numbers are one class
    assert classes(spark, [1.2] * 3 + [1.9] * 3 + [2.0] * 5, True) == [("1", 6), ("2", 5)]


def test_majority(spark):
    row = majority_baseline(class_table(answers(spark, ["a"] * 5 + ["b"] * 15), CELL), CELL).first()
    assert (row["n_samples"], row["n_classes"], row["majority_baseline"]) == (20, 2, 0.75)


def test_label_codes(spark):
    df = spark.createDataFrame([("q", "b"), ("q", "a"), ("q", None), ("q", "b")], "var_code string, val string")
    assert rows(label_codes(df, []).select("val", "code", "n")) == [("a", 0, 1), ("b", 1, 2)]
