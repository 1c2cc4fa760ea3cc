"""Windows of fixed length that occur more than once in a corpus, by shared anchors.

The plan that suffix arrays and suffix automata have in common:

1. *Runs.* Every window of ``window`` units has an anchor, the stretch of
   ``gram`` units with the smallest hash in it (leftmost on ties). Equal
   windows have equal anchors, so a window can only repeat among windows of its
   own anchor. Neighbouring windows that share an anchor form a run: one
   row with the anchor's hash and a digest of the run's units.
2. *Groups.* Runs whose anchor occurs once are dropped. Equal runs are counted
   before they are shuffled, and one of them stands for all.
3. *Matching.* The different runs of one anchor are the reference shard of
   that anchor; their units are fetched once, and the method (suffix array,
   suffix automaton) finds the windows they have in common. An anchor with more than
   ``HOT`` different runs, as a huge group of near copies makes, is split
   instead: its windows are dealt by their own digests.
4. *Spans.* What is found goes back to all runs, and per document to its text.

Nothing is sampled or capped; tasks see one shard at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.texts import Rolling, stored

# Different runs of one anchor up to which they are matched in one task.
HOT = 4096
# Window starts hashed at once; longer texts are taken in pieces.
PIECE = 1 << 20
# Bytes of runs that are matched at once.
BATCH_BYTES = 2 << 20
# Room for the number of windows of a run in the packed position.
PACK = 4096


@dataclass(frozen=True)
class Method:
    """How a text becomes units, and how runs of one anchor are matched.

    ``units(text)`` gives an array of numbers; ``cut(text, start, end)`` the bytes of units start to end;
    ``match(shards)`` takes lists of (document ordinal, bytes, windows), one per anchor, and
    gives per run the (from, to) ranges of its windows that are repeats.
    """

    window: int
    gram: int
    units: Callable[[], Callable[[bytes], np.ndarray]]
    cutter: Callable[[bytes], Callable[[int, int], bytes]]
    match: Callable[[list[list[tuple[int, bytes, int]]]], list[list[list[tuple[int, int]]]]]
    # Over an anchor's counted windows: is this one a repeat?
    repeat: Callable[[], Column]
    # Over a run's count, first place and own place: are all its windows repeats?
    whole: Callable[[], Column]


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows over ``width`` grams with one anchor: first window, end, anchor's place."""
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1: n])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.append(start[1:], len(least))
    return start, end, (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _runs(method: Method) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, rolling, width = method.units(), Rolling(0x9E3779B97F4A7C15), method.window - method.gram + 1
        for batch in batches:
            texts, rows, parts = batch.column("text"), [], []
            for i in range(len(texts)):
                items = units(texts[i].as_buffer())
                for at in range(0, len(items) - method.window + 1, PIECE):
                    piece = items[at: at + PIECE + method.window - 1]
                    prefix = rolling.prefix(piece)
                    first = np.arange(len(piece) - method.gram + 1)
                    grams = rolling.stretch(prefix, first, first + method.gram)
                    start, end, place = anchors(grams, width)
                    text = rolling.stretch(prefix, start, end + method.window - 1)
                    rows.append(np.full(len(start), i))
                    parts.append((grams[place], text, (start + at) * PACK + (end - start)))
            if rows:
                where = pa.array(np.concatenate(rows))
                mini, text, pos = (np.concatenate(x) for x in zip(*parts))
                yield pa.record_batch([batch.column("doc_id").take(where), batch.column("th").take(where), pa.array(mini.view(np.int64)),
                                       pa.array(text.view(np.int64)), pa.array(pos)], names=["doc_id", "th", "mini", "digest", "pos"])
    return run


def _cut(method: Method) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Units of each wanted run of a text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text"), batch.column("wanted")
            offsets = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            flat = wanted.flatten()
            pos = flat.field("pos").to_numpy(zero_copy_only=False)
            out, size, sent = [], 0, 0
            for i in range(len(texts)):
                cut = method.cutter(texts[i].as_py())
                for p in pos[offsets[i]: offsets[i + 1]].tolist():
                    out.append(cut(p // PACK, p // PACK + p % PACK + method.window - 1))
                    size += len(out[-1])
                if size > BATCH_BYTES or i == len(texts) - 1:
                    some = flat.slice(sent, len(out))
                    which = np.searchsorted(offsets, np.arange(sent, sent + len(out)), "right") - 1
                    yield pa.record_batch([some.field("mini"), some.field("digest"), some.field("n"), some.field("m"), some.field("many"),
                                           batch.column("doc_id").take(pa.array(which)), pa.array(out, pa.binary())],
                                          names=["mini", "digest", "n", "m", "many", "doc_id", "units"])
                    sent, out, size = sent + len(out), [], 0
    return run


RANGES = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
FOUND = T.StructType([T.StructField("mini", T.LongType()), T.StructField("digest", T.LongType()),
                      T.StructField("n", T.LongType()), T.StructField("ranges", RANGES)])


def _match(method: Method) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by anchor and document; anchors are kept whole."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(keys: list, shards: list) -> Iterator[pa.RecordBatch]:
        ranges = [r for shard in method.match(shards) for r in shard]
        kept = [(k, [{"a": a, "b": b} for a, b in r]) for k, r in zip(keys, ranges) if r]
        if kept:
            yield pa.record_batch([pa.array([k[i] for k, _ in kept], pa.int64()) for i in range(3)]
                                  + [pa.array([r for _, r in kept], kind)], names=FOUND.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shards, size, mini, doc, ordinal = [], [], 0, None, None, 0
        for batch in batches:
            for m, d, n, who, units in zip(*(batch.column(c).to_pylist() for c in ("mini", "digest", "n", "doc_id", "units"))):
                if not shards or m != mini:
                    if size >= BATCH_BYTES:
                        yield from solve(keys, shards)
                        keys, shards, size = [], [], 0
                    shards.append([])
                    mini, doc, ordinal = m, who, 0
                if who != doc:
                    doc, ordinal = who, ordinal + 1
                shards[-1].append((ordinal, units, n))
                keys.append((m, d, n))
                size += len(units)
        if keys:
            yield from solve(keys, shards)
    return run


def _windows(method: Method) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two digests of every window of the runs of a hot anchor."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, rollings = method.units(), (Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93))
        for batch in batches:
            for i in range(batch.num_rows):
                items = units(batch.column("units")[i].as_buffer())
                first = np.arange(len(items) - method.window + 1)
                w = [r.stretch(r.prefix(items), first, first + method.window).view(np.int64) for r in rollings]
                same = pa.array(np.full(len(first), i))
                yield pa.record_batch([batch.column(c).take(same) for c in ("mini", "digest", "n", "m", "doc_id")]
                                      + [pa.array(first.astype(np.int32)), *map(pa.array, w)],
                                      names=["mini", "digest", "n", "m", "doc_id", "a", "w1", "w2"])
    return run


def place(doc_id: str = "doc_id") -> Column:
    """Order of documents: by doc_id, rows without one last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"))


def spans(texts: DataFrame, method: Method, hot: int = HOT) -> DataFrame:
    """Per row of ``texts`` (doc_id, th, text) that has repeats: doc_id, th, spans of units to remove (may overlap)."""
    id_type = texts.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("th", "mini", "digest", "pos"))]
    runs = stored(texts.mapInArrow(_runs(method), T.StructType(fields)), "runs")
    # Counts are written before they are joined: Spark splits a hot key only where both sides come from a shuffle.
    shared = stored(runs.groupBy("mini").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("mini"), "anchors")
    runs = stored(runs.join(shared, "mini", "left_semi").withColumn("n", F.col("pos") % PACK), "shared")
    kinds = runs.groupBy("mini", "digest", "n").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct(place().alias("place"), "th", "pos")).alias("first"))
    kinds = stored(kinds, "kinds")
    several = stored(kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"), "several")
    wanted = kinds.join(several, "mini").select(
        F.col("first.place.doc_id").alias("_doc"), F.col("first.th").alias("_th"),
        F.struct("mini", "digest", "n", "m", (F.col("_k") > hot).alias("many"), F.col("first.pos").alias("pos")).alias("w"))
    wanted = wanted.groupBy("_doc", "_th").agg(F.collect_list("w").alias("wanted"))  # a document's own runs
    cut = texts.join(wanted, F.expr("doc_id <=> _doc AND th = _th"))
    cut = cut.select("doc_id", "text", "wanted").mapInArrow(_cut(method), T.StructType([
        *(T.StructField(c, T.LongType()) for c in ("mini", "digest", "n", "m")), T.StructField("many", T.BooleanType()),
        T.StructField("doc_id", id_type), T.StructField("units", T.BinaryType())]))
    cut = stored(cut, "cut")
    dealt = cut.filter("NOT many").repartition("mini").sortWithinPartitions("mini", F.col("doc_id").isNull(), "doc_id", "digest", "n")
    found = dealt.mapInArrow(_match(method), FOUND)
    found = found.unionByName(_hot_ranges(cut.filter("many"), method, id_type)).dropDuplicates(["mini", "digest", "n"])
    known = kinds.join(found, ["mini", "digest", "n"], "left").filter("m > 1 OR ranges IS NOT NULL")
    known = stored(known.select("mini", "digest", "n", "m", F.col("first.place").alias("first"), "ranges"), "known")
    hits = runs.join(known, ["mini", "digest", "n"]).withColumn("whole", method.whole()).filter("whole OR ranges IS NOT NULL")
    cover = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))).otherwise(F.col("ranges"))
    begin = F.floor(F.col("pos") / PACK).cast("int")
    return hits.select("doc_id", "th", F.transform(cover, lambda r: F.struct(
        (begin + r["a"]).alias("start"), (begin + r["b"] + (method.window - 1)).alias("end"))).alias("_s")).groupBy("doc_id", "th").agg(
            F.array_sort(F.flatten(F.collect_list("_s"))).alias("spans"))


def _hot_ranges(cut: DataFrame, method: Method, id_type: T.DataType) -> DataFrame:
    windows = stored(cut.mapInArrow(_windows(method), T.StructType([
        *(T.StructField(c, T.LongType()) for c in ("mini", "digest", "n", "m")), T.StructField("doc_id", id_type),
        T.StructField("a", T.IntegerType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType())])), "windows")
    seen = stored(windows.groupBy("w1", "w2").agg(F.sum("m").alias("times"), F.min(place()).alias("earliest")), "seen")
    return windows.join(seen, ["w1", "w2"]).filter(method.repeat()).groupBy("mini", "digest", "n").agg(
        F.transform(F.collect_list("a"), lambda a: F.struct(a.alias("a"), (a + 1).alias("b"))).alias("ranges"))


def removed(texts: DataFrame, found: DataFrame, keep: Callable[[bytes, np.ndarray], tuple[int, bytes]],
            schema: T.StructType) -> DataFrame:
    """All rows of ``texts`` with their spans merged: doc_id, n_units, spans, kept."""
    right = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "spans")
    rows = texts.join(right, F.expr("doc_id <=> _doc AND th = _th"), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed(keep), schema)


def result_schema(id_type: T.DataType) -> T.StructType:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("n_units", T.LongType()),
                         T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans sorted by start; touching spans are one run."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[new], reach[np.append(new[1:] - 1, len(start) - 1)]


def _removed(keep: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column("text"), batch.column("spans")
            counts, spans, kept = [], [], []
            for i in range(len(texts)):
                own = rows[i].values
                if own is None or not len(own):
                    s = e = np.empty(0, np.int32)
                else:
                    s, e = merged(own.field("start").to_numpy(zero_copy_only=False), own.field("end").to_numpy(zero_copy_only=False))
                n, rest = keep(texts[i].as_py(), s, e)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
                kept.append(rest)
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                  names=["doc_id", "n_units", "spans", "kept"])
    return run
