"""Shards by a hierarchical weighted hash tree (DataFrame functions only).

The tree has regions, racks and shards. A document descends: on each level
every child draws ``-ln(u) / weight`` from a hash of the document and the
child's name, and the smallest draw wins, so a child gets its share of the
weight below it. A child's draw depends on nothing but the document, its name
and its weight; when a weight changes, only documents that enter or leave that
child's subtree move. ``grown`` hangs a new shard into a region of its own, so
all that moves goes into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.texts import text_or_empty

# Pieces of a shard whose rows are numbered on their own.
PIECES = 256
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(regions: int = 5, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """A tree of regions x racks x shards of equal weight, shards numbered from 0."""
    return [Leaf(f"r{r}", f"r{r}k{k}", (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"new{new}", f"new{new}k", new, weight)]


def _level(tree: list[Leaf], parent: str | None, child: str) -> dict[str, list[tuple[str, float]]]:
    out: dict[str, dict[str, float]] = {}
    for leaf in tree:
        kids = out.setdefault(getattr(leaf, parent) if parent else "", {})
        kids[str(getattr(leaf, child))] = kids.get(str(getattr(leaf, child)), 0.0) + leaf.weight
    return {p: list(kids.items()) for p, kids in out.items()}


def _draw(key: str, level: str, kids: Column) -> Column:
    """Name of the child with the smallest draw; ``kids`` is an array of (name, weight)."""
    def draw(kid: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), kid["name"]), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / kid["weight"]).alias("d"), kid["name"].alias("name"))
    return F.array_min(F.transform(kids, draw))["name"]


def _kids(level: dict[str, list[tuple[str, float]]]) -> Column:
    """Map from each node to its children, a constant of the plan."""
    entries = []
    for parent, kids in level.items():
        entries += [F.lit(parent), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in kids))]
    return F.create_map(*entries)


def descend(docs: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """Adds ``out``: region, then rack of that region, then shard of that rack; one column per level."""
    if len({leaf.shard for leaf in tree}) < len(tree) or not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("shards must be distinct and some weight positive")
    live = [leaf for leaf in tree if leaf.weight > 0]
    at = F.lit("")
    for parent, child in ((None, "region"), ("region", "rack"), ("rack", "shard")):
        docs = docs.withColumn(f"_{child}", _draw(key, child, F.element_at(_kids(_level(live, parent, child)), at)))
        at = F.col(f"_{child}")
    return docs.withColumn(out, F.col("_shard").cast("int")).drop("_region", "_rack", "_shard")


def assign(docs: DataFrame, tree: list[Leaf] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes; rows without doc_id are keyed as one document;
    repeated rows get slots of their own. Slots count from 0 without gaps in
    each shard: rows are numbered inside ``PIECES`` pieces of a shard and
    shifted by the counts of the pieces before, so no task sorts a whole shard.
    An empty table gives no rows. Other columns are not read.
    """
    tree = even_tree() if tree is None else tree
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text_or_empty()) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = descend(descend(rows, "doc_id", tree, "shard"), "doc_id", grown(tree), "grown_shard")
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(F.lit("piece"), "doc_id", "text_crc32"), F.lit(PIECES)).cast("int"))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot`` to rows that hold shard, _piece, doc_id, text_crc32, size."""
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x PIECES rows, so the join sends it to every task.
    starts = rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "_piece"])
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard"))
