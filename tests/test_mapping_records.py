"""Raw responses to resolved mapping records, by hand."""

from surveyspark.plans.grid import choose, map_responses


def test_responses_to_chosen_variables(spark):
    responses = spark.createDataFrame([
        (1, "T", None, '[{"feature": "a \\"x\\"", "reasoning": "r"}, {"feature": "b", "reasoning": ""}, {"feature": "c"}, {"feature": "d"}]'),
        (2, "T", "C1", "no list"), (3, "U", "C1", '```json\n[{"feature": "e", "reasoning": "r"}]\n```')],
        "response_id long, target string, country string, raw_response string")
    at = {(1, 0): [1.0, 0.0], (1, 1): [0.0, 1.0], (1, 2): [-1.0, 0.0], (3, 0): [1.0, 0.0]}  # (1, 3) has no vector
    vectors = spark.createDataFrame([(r, k, v, v) for (r, k), v in at.items()],
                                    "response_id long, feature_rank int, label_vector array<double>, combined_vector array<double>")
    variables = spark.createDataFrame([("V1", [0.8, 0.6]), ("V2", [0.6, 0.8]), ("T", [1.0, 0.0])], "var_code string, vector array<double>")
    texts = spark.createDataFrame([("V1", "one"), ("V2", "two")], "var_code string, question_text string")
    targets = spark.createDataFrame([("T", [0.8, 0.6])], "target string, target_vector array<double>")
    answers = spark.createDataFrame([("1:0", "A"), ("1:1", "Answer: B"), ("3:0", "c")], "request_id string, raw_choice string")

    records = map_responses(responses, vectors, variables, texts, targets, leakage=0.97)
    got = {r["request_id"]: r for r in choose(records, answers).collect()}
    codes = {k: [c["var_code"] for c in r["candidates"]] for k, r in got.items()}
    # V1 is as close to the target T as a vector can be; U has no vector, so it leaves nothing out
    assert codes == {"1:0": ["V2"], "1:1": ["V2"], "1:2": [], "1:3": [], "3:0": ["T", "V1", "V2"]}
    assert {k: r["selected_code"] for k, r in got.items()} == {"1:0": "V2", "1:1": None, "1:2": None, "1:3": None, "3:0": "V2"}
    assert got["1:0"]["feature_label"] == 'a "x"' and got["3:0"]["selected_text"] == "two"
    assert {k: r["choice_response"] for k, r in got.items()} == {
        "1:0": "A", "1:1": "Answer: B", "1:2": "no candidates", "1:3": "no candidates", "3:0": "c"}


def test_shared_vectors_are_matched_once(spark, monkeypatch):
    """Features that name the same vectors give one request per target, and the records they would get alone."""
    from surveyspark.plans import grid

    raw = '[{"feature": "a"}, {"feature": "b"}, {"feature": "c"}, {"feature": "d"}]'
    responses = spark.createDataFrame([(i, "T" if i % 2 else None, None, raw) for i in range(6)],
                                      "response_id bigint, target string, country string, raw_response string")
    shared = {0: ([1.0, 0.0], [0.6, 0.8]), 1: ([0.0, 1.0], [0.0, 1.0])}
    ids = [(i, r, r % 3 if r % 3 < 2 else None) for i in range(6) for r in range(4)]
    vectors = spark.createDataFrame([(i, r, *shared[v]) for i, r, v in ids if v is not None],
                                    "response_id bigint, feature_rank int, label_vector array<double>, combined_vector array<double>")
    few = spark.createDataFrame([(v, *x) for v, x in shared.items()], "vector_id bigint, label_vector array<double>, combined_vector array<double>")
    variables = spark.createDataFrame([("T", [1.0, 0.0]), ("V1", [0.8, 0.6]), ("V2", [0.0, 1.0])], "var_code string, vector array<double>")
    texts = spark.createDataFrame([("V1", "one")], "var_code string, question_text string")
    targets = spark.createDataFrame([("T", [1.0, 0.0])], "target string, target_vector array<double>")
    asked = []
    nearest = grid.nearest_variables
    monkeypatch.setattr(grid, "nearest_variables", lambda requests, *rest: asked.append(requests.count()) or nearest(requests, *rest))
    alone = map_responses(responses, vectors, variables, texts, targets, leakage=0.97)
    together = map_responses(responses, few, variables, texts, targets, leakage=0.97,
                             feature_ids=spark.createDataFrame(ids, "response_id bigint, feature_rank int, vector_id bigint"))
    assert asked == [18, 4] and together.count() == 24
    columns = ["request_id", "target", "feature_label", "candidates", "top_match_code", "top_match_score"]
    assert sorted(map(str, together.select(columns).collect())) == sorted(map(str, alone.select(columns).collect()))


def test_ids_and_answers_from_columns(spark):
    """Ids of vectors and answers that follow from a record need no table, so responses are parsed once."""
    from pyspark.sql import functions as F

    raw = '[{"feature": "a"}, {"feature": "b"}, {"feature": "c"}]'
    responses = spark.createDataFrame([(i, "T", None, raw) for i in range(4)], "response_id bigint, target string, country string, raw_response string")
    few = spark.createDataFrame([(v, *x) for v, x in {0: ([1.0, 0.0], [0.6, 0.8]), 1: ([0.0, 1.0], [0.0, 1.0])}.items()],
                                "vector_id bigint, label_vector array<double>, combined_vector array<double>")
    variables = spark.createDataFrame([("T", [1.0, 0.0]), ("V1", [0.8, 0.6]), ("V2", [0.0, 1.0])], "var_code string, vector array<double>")
    texts = spark.createDataFrame([("V1", "one")], "var_code string, question_text string")
    targets = spark.createDataFrame([("T", [1.0, 0.0])], "target string, target_vector array<double>")
    rank = F.col("feature_rank")
    place, answer = (rank % 3).cast("bigint"), F.when(rank != 1, F.lit("A"))
    listed = spark.createDataFrame([(i, r, r) for i in range(4) for r in range(3)], "response_id bigint, feature_rank int, vector_id bigint")
    answers = spark.createDataFrame([(f"{i}:{r}", "A") for i in range(4) for r in range(3) if r != 1], "request_id string, raw_choice string")
    by_table = choose(map_responses(responses, few, variables, texts, targets, leakage=0.97, feature_ids=listed), answers)
    by_column = choose(map_responses(responses, few, variables, texts, targets, leakage=0.97, feature_ids=place), answer)
    columns = ["request_id", "candidates", "selected_code", "selected_text", "choice_response"]
    assert sorted(map(str, by_column.select(columns).collect())) == sorted(map(str, by_table.select(columns).collect()))
    assert by_column.count() == 12
