"""The text views hand whole texts on as they are."""

import json
from pathlib import Path

import pytest

from surveyspark.queries import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_responses_hold_every_sentence(spark):
    text = {r["doc_id"]: r["text"] for r in V.table(spark, SF, "documents").collect()}
    seen = set()
    for r in V.responses(spark, SF).collect():
        kind, raw = r["response_id"] % 12, r["raw_response"]
        want = [s.strip() for s in text[r["response_id"]].split(".") if s.strip()]
        if kind == 2:
            assert raw == text[r["response_id"]]
        if kind in (1, 10):
            assert [x["feature"] for x in json.loads(raw)] == want
        if kind in (4, 7, 8, 9, 11):
            body = raw if kind != 11 else raw.removeprefix("```json\n")
            with pytest.raises(json.JSONDecodeError):
                json.loads(body)
        seen.add(kind)
    assert seen == set(range(12))


def test_choices_hold_whole_turns(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in V.table(spark, SF, "conversations").collect()}
    rows = [r for r in V.choices(spark, SF).collect() if r["conv_id"] % 10 in (7, 8)]
    assert rows and all(r["raw"].startswith(turns[r["conv_id"], r["turn"]]) for r in rows)
    assert any(ord(c) > 127 for r in rows for c in r["raw"])
