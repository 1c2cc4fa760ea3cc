"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from surveyspark.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
AFTER = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FOLLOWS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = ["" if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(s if v is not None else " " for s, v in zip(said, (conv, turn))).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) of every state, row by row, with the repaired lines."""
    best = {0: (0, "", ())}

    def offer(table, state, cost, audit, lines):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, lines)

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                to, name = FOLLOWS[state]
                offer(table, to, cost + 5, audit + "I", (*lines, f"{name}:"))
        return table

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            offer(after, state, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (role[:1], state) in AFTER:
                offer(after, AFTER[role[:1], state], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            to, name = FOLLOWS[state]
            offer(after, to, cost + more + 1, audit + "R", (*lines, f"{name}:{text}"))
        best = after
    ends = [v for state, v in inserted(best).items() if state in (0, 3)]
    return min(ends, key=lambda v: v[:2])


def expected(rows):
    out = []
    for conv, kept in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            end = text.rstrip(" \t\n\v\f\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        cost, audit, lines = cheapest(kept, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    from pyspark.sql import functions as F
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("id", "seq", "copies", "run", "no", "_id", "audit")})
    return sorted((tuple(r) for r in conversations.audit(table, **options).collect()), key=repr)


def corpus():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ünd. ", "a. b", "long " * 50 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "superuser"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(9)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(10 ** 6)}."
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), text if rng.random() < 0.95 else None))
    rows += [(None, t, "user", f"x{t}.") for t in range(5)] + [(None, None, None, None), (7, 3, "user", "Yes."), (7, 3, "user", "Yes.")]
    rows += [(90, 0, "user", None)] * 3
    return rows


@pytest.mark.parametrize("size", [1, 3, 2048])
def test_equals_search(spark, size):
    assert found(spark, corpus(), size=size) == expected(corpus())


def test_long_conversations_that_never_settle(spark, monkeypatch):
    """All users, all repeats, all in order: boundary costs travel through many chunks."""
    rows = [(1, t, "user", f"u{t}.") for t in range(150)] + [(2, t, "user", "again.") for t in range(150)]
    rows += [(3, t, ("user", "assistant")[t % 2], f"x{t}.") for t in range(150)] + [(4, 1, "assistant", "same.")] * 150
    for passes in (0, 3):
        monkeypatch.setattr(conversations, "PASSES", passes)
        assert found(spark, rows, size=4) == expected(rows)


def test_stops_where_vectors_differ_by_a_constant():
    rng = random.Random(2)
    for _ in range(50):
        symbols = "".join(rng.choice("suaua?A-") for _ in range(300))
        shape, marks = conversations.backward(symbols, (0, 0, 0, 0))
        again, remarked = conversations.backward(symbols, conversations.END, marks)
        straight, wanted = conversations.backward(symbols, conversations.END)
        assert (shape if again is None else again) == straight and remarked == wanted


def test_no_rows(spark):
    assert found(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_other_id_types(spark):
    table = spark.createDataFrame([("a", 0, "user", "x."), ("a", 1, "user", "y.")], "conv_id string, turn int, role string, text string")
    assert [r.conv_id for r in conversations.audit(table).collect()] == ["a"]
