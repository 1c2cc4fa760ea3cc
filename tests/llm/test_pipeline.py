"""The corpus pipeline, stage by stage, against plain Python on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from surveyspark.llm import mixing, quality, tiling
from surveyspark.llm.texts import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def first_of_groups(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return {d for d in ids if find(d) == d}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outputs = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        outputs.append(docs.collect())
        assert docs.columns == columns or name == "sharding"
    raw, good, single, clean, mix, sharded = outputs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert {r.doc_id for r in good} == {d for d, kept in verdicts.items() if kept}
    assert {r.doc_id for r in single} == first_of_groups(good)
    items = [(r.text, {tuple(w[i:i + 4]) for w in [tiling.plain(r.text.encode())] for i in range(len(w) - 3)})
             for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean}
    for r in single:
        w = tiling.plain(r.text.encode())
        grams = {tuple(w[i:i + 4]) for i in range(len(w) - 3)}
        if any(t in r.text for t, _ in items):
            assert r.doc_id not in left
        elif not any(grams & g for _, g in items):
            assert r.doc_id in left
    size = {r.doc_id: len(r.text.encode().split()) for r in clean}
    own, taken = Counter(), Counter()
    for r in clean:
        own[r.source] += size[r.doc_id]
    for r in mix:
        taken[r.source] += size[r.doc_id]
    plan = mixing.Plan()
    names = sorted(own)
    weight = {s: plan.weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(own.values()) * 1.5, {}
    while True:
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s: 2 * own[s] for s in names if s not in capped and weight[s] * level > 2 * own[s]}
        if not over:
            break
        capped |= over
    longest = {s: max(size[r.doc_id] for r in clean if r.source == s) for s in names}
    assert all(abs(taken[s] - capped.get(s, weight[s] * level)) <= longest[s] / 2 + 1 for s in names)
    assert max(Counter(r.doc_id for r in mix).values()) <= 2
    assert Counter(r.doc_id for r in sharded) == Counter(r.doc_id for r in mix)
    slots = {}
    for r in sharded:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, sharded))


def test_tables_of_earlier_stages_go(spark):
    from surveyspark.session import shared_dir
    folder = Path(shared_dir(spark).removeprefix("file:"))
    was = set(folder.iterdir())
    out = corpus_pipeline.run(spark, SF)
    names = {d.name.rsplit("-", 1)[0] for d in set(folder.iterdir()) - was}
    assert not names & {"quality", "near_copies", "decontamination"} and "mixing" in names
    assert out.count() > 0
