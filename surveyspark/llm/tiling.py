"""Benchmark passages in documents by greedy string tiling with running Karp-Rabin.

Benchmark items and documents are compared as words in lower case without ASCII
punctuation. Rolling hashes of ``tile`` words are the seeds: a document that shares
seeds with an item gets its common stretches from runs of seeds on one
diagonal. The longest stretch is marked first; what marked words leave of
the others is queued again, until nothing of at least ``tile`` words is left. Tiles
don't overlap on either side and come in any order, so a passage whose sentences were
moved around is covered like an intact one. A document is contaminated if the tiles
cover at least ``coverage`` of an item.

The benchmark is sent to the tasks in shares of at most ``SHARE_BYTES`` of text; a larger
one takes several passes over the documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from surveyspark.llm.texts import Rolling, WordHash, text_or_empty

TILE = 4
COVERAGE = 0.5
SHARE_BYTES = 16 << 20
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


def tiles(places: np.ndarray, others: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length) from the places of shared seeds."""
    by = np.lexsort((places, places - others))
    d, i = places[by], others[by]
    new = np.concatenate(([True], (np.diff(d) != 1) | (np.diff(i) != 1)))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(d))) + tile - 1
    queue = [(-n, a, b) for n, a, b in zip(length.tolist(), d[begin].tolist(), i[begin].tolist())]
    heapq.heapify(queue)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [k for k in range(-n) if a + k not in in_doc and b + k not in in_item]
        if len(free) == -n:
            out.append((a, b, -n))
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= tile:
                    heapq.heappush(queue, (start - k, a + free[start], b + free[start]))
                start = k
    return sorted(out)


@dataclass
class Share:
    """Seeds of some items: sorted hashes, and the item and place of each."""

    ids: list
    lengths: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    tile: int
    rolling: Rolling = field(default_factory=lambda: Rolling(0xE7037ED1A0B428DB))

    @staticmethod
    def of(rows: list[tuple], tile: int) -> Share:
        known, rolling = WordHash(), Rolling(0xE7037ED1A0B428DB)
        hashed = [known.all(plain(text)) for _, text in rows]
        seeds = [seeds_of(h, tile, rolling) for h in hashed]
        item = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, int)
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        return Share([r[0] for r in rows], np.array([len(h) for h in hashed], np.int64), flat[by], item[by], place[by], tile)

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(item, covered words, tiles) of every item that shares a seed."""
        own = seeds_of(hashes, self.tile, self.rolling)
        lo, hi = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        times = (hi - lo)[hit]
        at = np.repeat(lo[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        places, item, other = np.repeat(hit, times), self.item[at], self.place[at]
        by = np.argsort(item, kind="stable")
        kinds, first = np.unique(item[by], return_index=True)
        out = []
        for k, mine in zip(kinds.tolist(), np.split(by, first[1:])):
            found = tiles(places[mine], other[mine], self.tile)
            out.append((k, sum(n for _, _, n in found), found))
        return out


def seeds_of(hashes: np.ndarray, tile: int, rolling: Rolling) -> np.ndarray:
    if len(hashes) < tile:
        return hashes[:0]
    prefix, first = rolling.prefix(hashes), np.arange(len(hashes) - tile + 1)
    return rolling.stretch(prefix, first, first + tile)


def _tile(share, item_type: pa.DataType, columns: list[str]):
    kind = pa.list_(pa.struct([("item_id", item_type), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct(
        [("start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())])))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = WordHash(), share.value
        for batch in batches:
            items = []
            for text in batch.column("__tiling_text"):
                found = of.matches(known.all(plain(text.as_buffer().to_pybytes())))
                items.append([{"item_id": of.ids[k], "coverage": n / int(of.lengths[k]), "tiles": [
                    {"start": a, "item_start": b, "length": ln} for a, b, ln in got]} for k, n, got in found])
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(items, kind)], names=[*columns, "__tiling_items"])
    return run


def tiled(docs: DataFrame, benchmark: DataFrame, tile: int = TILE) -> DataFrame:
    """``docs`` (without ``__tiling_text``) plus ``__tiling_items``: per item that shares a seed its coverage and tiles.

    Documents and items of fewer than ``tile`` words share nothing, nor do null texts.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", text_or_empty().cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = -(-max(total, 1) // SHARE_BYTES)
    kind = T.ArrayType(T.StructType([
        T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("coverage", T.DoubleType()),
        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "item_start", "length")])))]))
    rows = docs.withColumn("__tiling_text", text_or_empty().cast("binary"))
    keep, found = docs.columns, None
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    for k in range(shares):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(shares)) == k).collect()  # about SHARE_BYTES
        share = spark.sparkContext.broadcast(Share.of([(r["item_id"], bytes(r["text"])) for r in own], tile))
        columns = keep if found is None else [*keep, "__tiling_before"]
        part = rows if found is None else found.withColumn("__tiling_text", text_or_empty().cast("binary"))
        schema = T.StructType([*(docs.schema[c] for c in keep), *([] if found is None else [T.StructField("__tiling_before", kind)]),
                               T.StructField("__tiling_items", kind)])
        found = part.select(*columns, "__tiling_text").mapInArrow(_tile(share, id_type, columns), schema)
        if "__tiling_before" in columns:
            found = found.withColumn("__tiling_items", F.concat("__tiling_before", "__tiling_items")).drop("__tiling_before")
        if k + 1 < shares:
            found = found.withColumnRenamed("__tiling_items", "__tiling_before")
    return found


def judge(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_items (covered enough), item_id (best, smallest on ties), coverage (of that), contaminated.

    A null or empty text is clean; an empty benchmark leaves all clean; repeated
    rows and null ids are judged as they are; other columns are not read.
    """
    found = tiled(docs.select("doc_id", "text"), benchmark, tile)
    best = F.array_min(F.transform("__tiling_items", lambda i: F.struct((-i["coverage"]).alias("minus"), i["item_id"].alias("item_id"))))
    enough = F.size(F.filter("__tiling_items", lambda i: i["coverage"] >= coverage))
    return found.select("doc_id", enough.cast("long").alias("n_items"), best["item_id"].alias("item_id"),
                        F.coalesce(-best["minus"], F.lit(0.0)).alias("coverage"), (enough > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    found = tiled(docs, benchmark, tile)
    return found.filter(~F.exists("__tiling_items", lambda i: i["coverage"] >= coverage)).drop("__tiling_items")
