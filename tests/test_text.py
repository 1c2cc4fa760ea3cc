import pytest
from pyspark.sql import functions as F

from surveyspark.functions import text as X
from surveyspark.operators import requests as R


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,n", [
    ('[{"feature": "age", "reasoning": "r"}]', 1),
    ('```json\n[{"feature": "a"}, {"feature": "b"}]\n```', 2),
    ('  ```\n[]\n```  ', 0),
    ('[{"feature": "a"}] and more', None),
    ('{"feature": "a"}', None),
    ('["a", "b"]', None),
    ("prose", None), ("", None), (None, None),
    ('[{"feature": "a"}] see [1]', None), ("[] or []", None), ("[{'feature': 'a'}]", None), ('[{"feature": "a [b] \\"c\\" ]"}]', 1),
    ('[], "x": []', None), ('[]} {"r": []', None), ('[{"feature": "a"', None),
])
def test_feature_lists(spark, raw, n):
    got = one(spark, raw, X.parse_feature_list)
    assert (None if got is None else len(got)) == n


@pytest.mark.parametrize("raw,n,strict,legacy", [
    ("B", 3, 1, 1), (" b ", 3, 1, 1), ("none", 3, None, None), ("None of these", 3, None, None),
    ("Answer: B", 3, 1, 0), ("C because A is off", 3, 2, 0), ("Z", 3, None, None), ("", 3, None, None),
    ("(D)", 4, 3, 3), ("(D)", 3, None, None), ("I think B", 3, 1, 1), ("I choose B", 5, 1, 1), ("F", 8, 5, 5), ("H or A", 8, 7, 0),
    ("D, no: B", 3, 1, 1), (None, 3, None, None),
    ("\u00e9A, B", 3, 1, 0), ("A\u00df", 3, None, 0), ("A\u0301 C", 3, 2, 0), ("Ö: c\n", 3, 2, 2), ("1A 2", 3, None, 0), ('"b"', 3, 1, 1),
])
def test_choices(spark, raw, n, strict, legacy):
    assert one(spark, raw, lambda c: X.parse_choice(c, F.lit(n))) == strict
    assert one(spark, raw, lambda c: X.parse_choice(c, F.lit(n), legacy=True)) == legacy


def test_raw_texts_survive_the_list(spark):
    texts = ['say "x" [1]', "it's {a}, [b]", "back\\slash \\n", "tab\tline\nend", "\u00e9\u00fc\u00e4 \u00df 42 %", "```"]
    body = F.to_json(F.transform(F.col("v"), lambda s: F.struct(s.alias("feature"), s.alias("reasoning"))))
    for raw in (body, F.concat(F.lit("```json\n"), body, F.lit("\n```"))):
        got = spark.createDataFrame([(texts,)], "v array<string>").select(X.parse_feature_list(raw)).first()[0]
        assert [(x.feature, x.reasoning) for x in got] == [(t, t) for t in texts]
    escaped = F.lit('[{"f\\u0065ature": "\\u00e9\\/\\"", "reasoning": null}]')
    got = spark.range(1).select(X.parse_feature_list(escaped)).first()[0]
    assert [(x.feature, x.reasoning) for x in got] == [('\u00e9/"', None)]


def test_demographic_flag(spark):
    assert one(spark, "Language use", X.is_demographic) is True
    assert one(spark, "Language use", lambda c: X.is_demographic(c, whole_word=True)) is False
    assert one(spark, "AGE group", lambda c: X.is_demographic(c, whole_word=True)) is True
    assert one(spark, None, X.is_demographic) is False
    assert one(spark, "hobbies", X.is_demographic) is False


def test_inserted_text_is_not_filled_again(spark):
    out = one(spark, "say {country}", lambda c: X.request_text(c, F.lit("Chile")))
    assert 'in Chile: "say {country}"' in out and out.count("Chile") == 2
    assert "in " not in one(spark, "q", lambda c: X.request_text(c, F.lit(""))).split(":")[0]


def test_combined_text(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), ("a", None), (None, "b")], "l string, r string")
    got = [r[0] for r in df.select(X.combined_text(F.col("l"), F.col("r"))).collect()]
    assert got == ["a: b", "a", "a", ": b"]


def test_resolving_out_of_range_and_empty(spark):
    cand = "array<struct<var_code:string,question_text:string,similarity:double>>"
    data = [(1, [("V1", "one", 0.5), ("V2", "two", 0.4)], "B"), (2, [("V1", "one", 0.5)], "B"),
            (3, [], "A"), (4, [("V1", "one", 0.5)], "none"), (5, [("V1", "one", 0.5)], None)]
    df = spark.createDataFrame(data, f"id int, candidates {cand}, raw_choice string")
    got = {r["id"]: (r["selected_code"], r["selected_rank"], r["choice_response"]) for r in R.resolve_choices(df).collect()}
    assert got == {1: ("V2", 1, "B"), 2: (None, None, "B"), 3: (None, None, "no candidates"),
                   4: (None, None, "none"), 5: (None, None, None)}


def test_grid_and_conditions(spark):
    targets = spark.createDataFrame([("s", "q1", "text"), ("s", "q2", "text")], "survey string, target string, question_text string")
    lands = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "C")], "survey string, country string")
    assert R.grid_cells(targets, lands).count() == 4
    grid = R.build_requests(R.request_grid(targets, lands))
    assert grid.where("condition = 'unprompted'").count() == 2 and grid.count() == 6
    assert {r.system for r in grid.collect()} == {X.SYSTEM_TEXT}
    assert R.request_grid(targets, lands, condition="unprompted").count() == 2
    with pytest.raises(ValueError):
        R.request_grid(targets, lands, condition="x")
