"""Repair of conversation structure by rank-convergence parallel Viterbi.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Edits
keep, rerole, delete or insert rows; the audit is the string of the cheapest
edits' initials. The rows walk a machine of four states (start, after system, after user,
after assistant), so the cost from a row to the end is a vector of four
numbers, computed backward over the rows (Viterbi).

Rows are sorted by conversation and turn over range partitions, where a tie-break splits even
equal rows, and cut into chunks of at most ``CHUNK`` rows. A conversation that
lies inside one partition and one chunk is repaired where it is read. The chunks of
all others, which may be one conversation with a third of all rows, are
independent tasks:

1. Each chunk but the last of its conversation starts from a speculative cost vector and
   yields the vector at its first row.
2. Fix-up passes: a chunk whose successor's vector differs from the one it used by
   more than a constant runs again, and stops where its vector differs from its
   earlier one by a constant only, as everything before it then stays.
   Few passes settle the usual conversation.
3. What is still unsettled after ``PASSES`` passes (long stretches that never forget where
   they began, such as deleted rows only) gets its vectors from the chunks'
   4 x 4 cost matrices, combined in pairs, so that the number of rounds is a logarithm.
4. Each chunk traces its cheapest edits forward, by its stitched costs, from all four states;
   the states in which the chunks are entered follow by combining these maps in pairs.

Only the final digest of a conversation reads its chunks in order, as a stream of
finished lines: SHA-256 knows no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from surveyspark.llm.texts import stored

# Rows and characters of a chunk; rows between two marks, where a pass may stop; passes before matrices take over.
CHUNK, CHUNK_CHARS, MARK, PASSES = 2048, 1 << 20, 64, 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: 0 start, 1 after system, 2 after user, 3 after assistant. What a role's initial leads to, and what fits next.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT = (2, 2, 3, 2)
# Cost of what can't be reached.
FAR = 1 << 50
NAMES = {2: "user", 3: "assistant"}
# Cost from the end of a conversation: inserts that complete a pair.
END = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


def _edges(symbol: str) -> tuple[tuple[str, int, tuple], ...]:
    """Edits of a row in the order of their initials: initial, cost, state after it per state before it.

    A symbol is ``-`` for rows that must go, else the role's initial (``?`` for others), in upper case if truncated.
    """
    stay = ("D", DELETE, (0, 1, 2, 3))
    if symbol == "-":
        return (stay,)
    more = TRUNCATED if symbol.isupper() or symbol == "!" else 0
    keep = ("K", KEEP + more, tuple(STEP.get((symbol.lower(), q)) for q in range(4)))
    return stay, keep, ("R", REROLE + more, NEXT)


EDGES = {s: _edges(s) for s in "-suaSUA?!"}


def _back(symbol: str, ahead: tuple) -> tuple:
    """Costs before a row from those after it; inserts may come before it."""
    out = [min(cost + ahead[to[q]] for _, cost, to in EDGES[symbol] if to[q] is not None) for q in range(4)]
    user, assistant = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return min(out[0], INSERT + user), min(out[1], INSERT + user), user, assistant


def _shape(costs) -> tuple:
    low = min(costs)
    return tuple(c - low for c in costs)


_MEMO: dict = {}


def _shaped(symbol: str, shape: tuple) -> tuple[tuple, int]:
    """``_back`` of a shape: the shape before the row, and the constant that was taken off. There are few shapes."""
    key = (symbol, shape)
    if key not in _MEMO:
        out = _back(symbol, shape)
        _MEMO[key] = _shape(out), min(out)
    return _MEMO[key]


def backward(symbols: str, end: tuple, marks: list | None = None) -> tuple[tuple, list]:
    """Shape at the first row from the shape behind the last one, and the shapes at every ``MARK``-th row from the end.

    With the marks of an earlier pass it stops at the first that is equal: shapes are equal where vectors differ by constants.
    """
    shape, seen = end, []
    for n, symbol in enumerate(reversed(symbols), 1):
        shape = _shaped(symbol, shape)[0]
        if n % MARK == 0:
            seen.append(shape)
            if marks is not None and marks[len(seen) - 1] == shape:
                return None, seen + marks[len(seen):]
    return shape, seen


def trace(symbols: str, costs: list[tuple], state: int, last: bool) -> tuple[str, int]:
    """ASCII-least of the cheapest audits from ``state``, and the state behind it.

    ``costs`` holds the true costs (up to one constant) before each row and behind the last.
    """
    out, r = [], 0
    while r < len(symbols):
        here = costs[r][state]
        options = [(name, cost, to[state]) for name, cost, to in EDGES[symbols[r]] if to[state] is not None]
        for name, cost, to in options:
            if name == "D" and cost + costs[r + 1][to] == here:
                break
        else:
            if INSERT + costs[r][NEXT[state]] == here:
                out.append("I")
                state = NEXT[state]
                continue
            name, cost, to = next(o for o in options if o[0] != "D" and o[1] + costs[r + 1][o[2]] == here)
        out.append(name)
        state, r = to, r + 1
    while last and END[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def costs_of(symbols: str, end: tuple) -> tuple[list[tuple], int]:
    """Costs before each row and behind the last, up to the last one's constant."""
    costs, total = [end], 0
    for symbol in reversed(symbols):
        shape, more = _shaped(symbol, _shape(costs[-1]))
        total = min(costs[-1]) + more
        costs.append(tuple(c + total for c in shape))
    costs.reverse()
    return costs, total


def lines(audit: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The repaired rows of an audit as ``role:text``."""
    out, r = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:")
            continue
        if edit == "K":
            state = STEP[roles[r][:1], state]
            out.append(f"{roles[r]}:{texts[r]}")
        elif edit == "R":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[r]}")
        r += 1
    return out


def symbol_of(role: str, text: str) -> str:
    """Symbol of a row that is not a duplicate."""
    end = text.rstrip(SPACE)[-1:]
    if not end:
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return initial if end in ".!?" else initial.upper().replace("?", "!")


class Chunk:
    """Rows of one conversation that follow each other in one partition."""

    def __init__(self) -> None:
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def facts(self, again: Iterable[int] = ()) -> dict:
        """Counts and symbols; ``again`` holds places of rows that an earlier chunk has seen."""
        seen, again, symbols, counts = set(), set(again), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, row in enumerate(zip(self.roles, self.texts)):
            symbol = symbol_of(*row)
            if symbol == "-":
                counts["blank"] += 1
            elif i in again or row in seen:
                counts["duplicate"] += 1
                symbol = "-"
            elif symbol.isupper() or symbol == "!":
                counts["truncated"] += 1
            seen.add(row)
            symbols.append(symbol)
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return counts | {"symbols": "".join(symbols), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                         "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "role", "text", "copies")))


def _cut(id_type: pa.DataType, size: int):
    """Whole conversations repaired, and the chunks of those that may go on in another partition."""
    kinds = {"id": id_type, "seq": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "sha": pa.string(),
             "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        out = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({k: pa.array([row.get(k) for row in out], t) for k, t in kinds.items()})
            out.clear()
            return made

        def close(key, chunk: Chunk, whole: bool) -> None:
            nonlocal number
            if whole:
                f = chunk.facts()
                costs, _ = costs_of(f["symbols"], END)
                audit, _ = trace(f["symbols"], costs, 0, True)
                text = "\n".join(lines(audit, chunk.roles, chunk.texts, 0))
                out.append({"id": key, "gaps": _gaps(f["low"], f["high"], f["turns"]), **{c: f[c] for c in COUNTS[1:5]},
                            "cost": costs[0][0], "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()})
            else:
                out.append({"id": key, "seq": (part << 32) + number, "turns": chunk.turns, "roles": chunk.roles, "texts": chunk.texts})
                number += 1

        chunk, key, first, cut, weight = None, None, True, False, 0
        for id_, turn, role, text, copies in _rows(batches):
            if chunk is not None and id_ != key:
                close(key, chunk, not first and not cut)
                chunk, first, cut = None, False, False
            if chunk is None:
                chunk, key = Chunk(), id_
            for _ in range(copies):
                if len(chunk.turns) >= size or chunk.chars >= CHUNK_CHARS:
                    close(key, chunk, False)
                    weight += chunk.chars
                    chunk, cut = Chunk(), True
                chunk.add(turn, role, text)
            if len(out) >= 1000 or weight > CHUNK_CHARS:
                if out:
                    yield batch()
                weight = 0
        if chunk is not None:  # the last one may go on in the next partition
            close(key, chunk, False)
        if out:
            yield batch()
    return run


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """The rows after damage by a checksum of conversation and turn: id, turn, role, text, copies. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said(key), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.filter(kind != 0).select(
        F.col(key).alias("id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _struct(id_type: T.DataType, *fields: str) -> T.StructType:
    kinds = {"id": id_type, "seq": T.LongType(), **dict.fromkeys(COUNTS, T.LongType()), "audit": T.StringType(), "sha": T.StringType(),
             "turns": T.ArrayType(T.LongType()), "roles": T.ArrayType(T.StringType()), "texts": T.ArrayType(T.StringType()),
             "symbols": T.StringType(), "shape": T.ArrayType(T.LongType()), "marks": T.ArrayType(T.LongType()),
             "used": T.ArrayType(T.LongType()), "matrix": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(f, kinds[f]) for f in fields])


def _flat(shapes: list) -> list:
    return [c for s in shapes for c in s]


def _deep(flat: list) -> list:
    return [tuple(flat[i:i + 4]) for i in range(0, len(flat), 4)]


def _pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs chunks backward from ``used``; those that ran before bring shape and marks."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            old = _deep(row["marks"]) if row["marks"] is not None else None
            shape, marks = backward(row["symbols"], tuple(row["used"]), old)
            out.append({"seq": row["seq"], "symbols": row["symbols"], "used": row["used"],
                        "shape": row["shape"] if shape is None else list(shape), "marks": _flat(marks)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("seq", pa.int64()), ("symbols", pa.string()), *(
            (c, pa.list_(pa.int64())) for c in ("used", "shape", "marks"))]))


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost from each state before a chunk to each state behind it."""
    for batch in batches:
        out = []
        for seq, symbols in zip(batch.column("seq").to_pylist(), batch.column("symbols").to_pylist()):
            columns = [tuple(0 if q == to else FAR for q in range(4)) for to in range(4)]
            for symbol in reversed(symbols):
                columns = [_back(symbol, ahead) for ahead in columns]
            out.append((seq, [min(FAR, columns[to][q]) for q in range(4) for to in range(4)]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))],
                                         names=["seq", "matrix"])


def _grid(cell) -> Column:
    """A 4 x 4 matrix, flat, of ``cell(row, column)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: cell(F.floor(t / 4).cast("int"), (t % 4).cast("int")))


def _times(a: Column, b: Column) -> Column:
    """Min-plus product of two flat matrices."""
    return _grid(lambda i, j: F.least(F.lit(FAR), F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(a, i * 4 + k) + F.get(b, k * 4 + j)))))


def _doubled(table: DataFrame, value: str, combine, name: str, ahead: bool) -> DataFrame:
    """``value`` of every row combined with those of all rows of its run behind it (``ahead``) or before it, in log2 rounds.

    ``table`` holds run, no (0, 1, ... in a run) and ``value``; ``combine(own, other)`` is associative.
    """
    reach = 1
    most = table.agg(F.max("no")).first()[0] or 0
    while reach <= most:
        other = table.select("run", (F.col("no") + (-reach if ahead else reach)).alias("no"), F.col(value).alias("_other"))
        table = stored(table.join(other, ["run", "no"], "left").withColumn(
            value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_other")))).drop("_other"), name)
        reach *= 2
    return table


def settled(chunks: DataFrame) -> DataFrame:
    """Shape behind every chunk: seq, run, no, end. ``chunks`` holds run, no, last, seq, symbols; run and no name a chunk."""
    start = F.array(*(F.lit(c).cast("long") for c in END))
    guess = F.array(*(F.lit(0).cast("long") for _ in END))
    state = _struct(T.LongType(), "seq", "symbols", "used", "shape", "marks")
    place = chunks.select("seq", "run", "no", "last")
    now = chunks.select("seq", "symbols", F.when(F.col("last"), start).otherwise(guess).alias("used"),
                        F.lit(None).cast("array<bigint>").alias("shape"), F.lit(None).cast("array<bigint>").alias("marks"))
    now = stored(now.mapInArrow(_pass, state), "vectors")
    for left in range(PASSES, -1, -1):
        # The vector that the successor found, beside the one that was used.
        ahead = now.join(place, "seq").select("run", (F.col("no") - 1).alias("no"), F.col("shape").alias("ahead"))
        rows = stored(now.join(place, "seq").join(ahead, ["run", "no"], "left"), "vectors")
        stale = F.coalesce(F.col("ahead") != F.col("used"), F.lit(False))
        if rows.filter(stale).isEmpty():
            return rows.select("seq", "run", "no", F.col("used").alias("end"))
        if not left:
            break
        again = rows.filter(stale).withColumn("used", F.col("ahead")).select(*state.names).mapInArrow(_pass, state)
        now = stored(rows.filter(~stale).select(*state.names).unionByName(again), "vectors")
    # Runs that are still unsettled: costs behind a chunk follow from the matrices of all chunks behind it.
    matrices = chunks.select("seq", "symbols").mapInArrow(_matrices, _struct(T.LongType(), "seq", "matrix"))
    tail = _doubled(stored(matrices.join(place, "seq").select("run", "no", "matrix"), "matrices"), "matrix", _times, "matrices", True)
    ends = tail.select("run", (F.col("no") - 1).alias("no"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_min(
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(F.col("matrix"), i * 4 + k) + F.get(start, k)))).alias("end"))
    shape = F.transform("end", lambda c: c - F.array_min("end"))
    return place.join(ends, ["run", "no"], "left").select("seq", "run", "no", F.when(F.col("last"), start).otherwise(shape).alias("end"))


def _exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State behind a chunk for each state before it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            costs, _ = costs_of(row["symbols"], tuple(row["end"]))
            out.append([trace(row["symbols"], costs, q, False)[1] for q in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, pa.list_(pa.int64()))], names=["seq", "exits"])


def entered(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """State in which every chunk is entered: seq, end, state."""
    maps = chunks.select("seq", "symbols").join(ends.select("seq", "end"), "seq").mapInArrow(_exits, T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("exits", T.ArrayType(T.LongType()))]))
    maps = stored(maps.join(ends, "seq").select("run", "no", "exits"), "exits")
    follow = lambda own, before: F.transform(before, lambda q: F.get(own, q.cast("int")))
    before = _doubled(maps, "exits", follow, "exits", False).select("run", (F.col("no") + 1).alias("no"), F.get("exits", F.lit(0)).alias("state"))
    return ends.join(before, ["run", "no"], "left").select("seq", "end", F.coalesce("state", F.lit(0).cast("long")).alias("state"))


def _chunk(row: dict) -> Chunk:
    chunk = Chunk()
    chunk.turns, chunk.roles, chunk.texts = row["turns"], row["roles"], row["texts"]
    return chunk


def _symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_chunk(row).facts(row["again"] or ())["symbols"] for row in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, pa.string())], names=["seq", "symbols"])


def _repaired(id_type: pa.DataType):
    """Edits of a chunk: its part of the audit, its repaired lines, and what the conversation's counts need."""
    schema = pa.schema([("id", id_type), ("seq", pa.int64()), *((c, pa.int64()) for c in (*COUNTS[1:], "low", "high", "turns")),
                        ("first", pa.string()), ("final", pa.string()), ("low_end", pa.int64()), ("high_end", pa.int64()),
                        ("audit", pa.string()), ("lines", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chunk = _chunk(row)
                f = chunk.facts(row["again"] or ())
                costs, offset = costs_of(f["symbols"], tuple(row["end"]))
                audit, _ = trace(f["symbols"], costs, row["state"], row["last"])
                # Constants of all chunks add up; the first chunk adds the start's cost over the least.
                cost = offset + (costs[0][0] - offset if row["no"] == 0 else 0)
                out.append(f | {"id": row["id"], "seq": row["seq"], "cost": cost, "audit": audit, "first": chunk.roles[0][:1],
                                "final": chunk.roles[-1][:1], "low_end": chunk.turns[0], "high_end": chunk.turns[-1],
                                "lines": lines(audit, chunk.roles, chunk.texts, row["state"])})
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in schema.names} for row in out], schema)
    return run


def _folded(id_type: pa.DataType):
    """One row per conversation from its chunks in order; one chunk is held at a time."""
    schema = pa.schema([("id", id_type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("sha", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def close() -> dict:
            held["sha"] = held["digest"].hexdigest()
            held["gaps"] = _gaps(held["low"], held["high"], held["turns"])
            held["audit"] = "".join(held["audits"])
            return {k: held[k] for k in schema.names}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is None or row["id"] != key:
                    if held is not None:
                        out.append(close())
                    key = row["id"]
                    held = {"id": key, "digest": hashlib.sha256(), "audits": [], "low": None, "high": None, "turns": 0, "final": None,
                            "high_end": None, "any": False, **dict.fromkeys(COUNTS, 0)}
                for c in COUNTS[1:]:
                    held[c] += row[c]
                if held["final"] is not None:
                    held["illegal"] += held["final"] + row["first"] not in LEGAL
                # Turns are in order, nulls first: only the turn at the border can be in both chunks.
                held["turns"] += row["turns"] - (row["low_end"] is not None and row["low_end"] == held["high_end"])
                held["low"] = row["low"] if held["low"] is None else held["low"]
                held["high"] = held["high"] if row["high"] is None else row["high"]
                held["final"], held["high_end"] = row["final"], row["high_end"]
                held["audits"].append(row["audit"])
                for line in row["lines"]:
                    held["digest"].update(("\n" + line if held["any"] else line).encode())
                    held["any"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([close()], schema)
    return run


def _said(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every different row of a chunk, and its first place."""
    for batch in batches:
        for row in batch.to_pylist():
            places = {}
            for i, (role, text) in enumerate(zip(row["roles"], row["texts"])):
                places.setdefault(hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest(), i)
            yield pa.RecordBatch.from_arrays([pa.array([row["seq"]] * len(places), pa.int64()), pa.array(places.values(), pa.int32()),
                                              pa.array(places.keys(), pa.binary())], names=["seq", "place", "said"])


def _seen_before(chunks: DataFrame, place: DataFrame) -> DataFrame:
    """Places of rows that an earlier chunk of their conversation holds, the first of equal ones: seq, again."""
    said = T.StructType([T.StructField("seq", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("said", T.BinaryType())])
    rows = stored(chunks.select("seq", "roles", "texts").mapInArrow(_said, said).join(place.select("seq", "run"), "seq"), "said")
    firsts = rows.groupBy("run", "said").agg(F.min("seq").alias("first"))
    later = rows.join(stored(firsts, "firsts"), ["run", "said"]).filter("seq > first")
    return later.groupBy("seq").agg(F.collect_list("place").alias("again"))  # at most the rows of a chunk


def repair(rows: DataFrame, key: str = "conv_id", size: int = CHUNK) -> DataFrame:
    """One row per conversation that has rows after damage: ``key``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are as :func:`damaged` gives them: id, turn, role, text, copies, null-free but for id and turn. Rows of
    one turn are taken by role, the text's first 64 characters and its md5; repeated rows are duplicates. Rows without id are one
    conversation. Very long texts make shorter chunks. An empty table gives no rows.
    """
    id_type = rows.schema["id"].dataType
    # The number of a row in its file breaks ties, so that equal rows can be split.
    order = [F.asc_nulls_first("id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_head"), F.asc("_digest"), F.asc("_tie")]
    tied = rows.withColumns({"_head": F.left("text", F.lit(64)), "_digest": F.md5("text"), "_tie": F.monotonically_increasing_id()})
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    arrow = to_arrow_type(id_type)
    cut = stored(ordered.select("id", "turn", "role", "text", "copies").mapInArrow(_cut(arrow, size), _struct(
        id_type, "id", "seq", *COUNTS, "audit", "sha", "turns", "roles", "texts")), "conversations")
    out = ["id", *COUNTS, "audit", "sha"]
    run = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    inside = Window.partitionBy("id").orderBy("seq")  # one short row per chunk
    chunks = cut.filter("seq IS NOT NULL")
    place = stored(chunks.select("seq", "id").withColumn("no", F.row_number().over(inside) - 1).withColumn(
        "last", F.lead("seq").over(inside).isNull()).select("seq", run.alias("run"), "no", "last"), "places")
    chunks = chunks.join(place, "seq")
    again = stored(_seen_before(chunks, place), "again")
    chunks = chunks.join(again, "seq", "left")
    symbols = stored(chunks.select("seq", "turns", "roles", "texts", "again").mapInArrow(_symbols, T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("symbols", T.StringType())])).join(place, "seq"), "symbols")
    states = stored(entered(symbols, stored(settled(symbols), "ends")), "states")
    longs = [T.StructField(c, T.LongType()) for c in (*COUNTS[1:], "low", "high", "turns")]
    done = chunks.join(states, "seq").select("id", "seq", "no", "last", "turns", "roles", "texts", "again", "end", "state").mapInArrow(
        _repaired(arrow), T.StructType([
            T.StructField("id", id_type), T.StructField("seq", T.LongType()), *longs, T.StructField("first", T.StringType()),
            T.StructField("final", T.StringType()), T.StructField("low_end", T.LongType()), T.StructField("high_end", T.LongType()),
            T.StructField("audit", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))]))
    folded = done.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(_folded(arrow), _struct(id_type, *out))
    return cut.filter("seq IS NULL").select(*out).unionByName(folded).withColumnsRenamed({"id": key, "sha": "repaired_sha256"})


def audit(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every conversation of the table, damaged and repaired; those without rows after damage have zeros and an empty audit."""
    done = repair(damaged(conversations.select("conv_id", "turn", "role", "text")), size=size)
    done = done.withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct()
    rows = every.join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
