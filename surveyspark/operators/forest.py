"""Bagged decision trees for all cells, folds and bags at once, grown level by level from histograms.

The second learner: unlike ``operators.bayes`` it sees interactions. Answers become bins in answer order. Rows of a cell
lie in blocks, one record with an array per column, written once. Each level is one pass over the blocks: class counts per
(cell, fold, tree, node, feature, bin), counted per block with numpy and summed up by Spark. The best split of every node
follows from them, and a row finds its node again by walking the splits so far, so no row moves. What is sent to blocks per
cell is one entry per split, bounded by folds x trees x nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.numbers import seeded_key, to_number
from surveyspark.operators.bayes import MOST_LOOKUPS
from surveyspark.operators.profiles import CELL, MISSING, Profiles
from surveyspark.operators.ranking import ordered_row_number
from surveyspark.operators.resampling import SEED
from surveyspark.session import BROADCAST_BYTES, BROADCAST_ROWS, Materialized, materialize

# Trees per fold, levels of splits, rows a child needs, and bins per feature.
TREES, DEPTH, MIN_ROWS, BINS = 10, 4, 5, 32
# Rows of a bag, and features tried at a node: those whose seeded key begins below this (205 of 256, 80 %).
SHARE = "cd"
NONE, ABSENT = -1, -2  # bin of a missing answer, and at the target's place
LEAST_GAIN = 1e-9
# Answers of a block, blocks that are packed together, and rows handed on at once.
BLOCK_ANSWERS, PACKED, OUT_ROWS = 1 << 20, 2, 1 << 18


def feature_bins(p: Profiles) -> Materialized:
    """Bin of every answer: cell, feature, val, bin.

    Answers are put in number order where all of a feature's answers in the cell are numbers, else in text order; each has a
    bin of its own up to ``BINS``, beyond that bins hold equally many different answers.
    """
    rows = p.answers(p.df.where(F.col("y").isNotNull()).select(*CELL, "x")).where(F.col("val") != MISSING)
    feature = [*CELL, "feature"]
    values = rows.groupBy(*feature, "val").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    kinds = values.groupBy(*feature).agg(F.bool_and(to_number(F.col("val")).isNotNull()).alias("_number"), F.count(F.lit(1)).alias("_all"))
    values = values.join(kinds, feature).withColumn("_order", F.struct(F.when(F.col("_number"), to_number(F.col("val"))).alias("num"), "val"))
    numbered = ordered_row_number(materialize(values), feature, "_order")
    at = F.col("rn") - 1
    return materialize(numbered.select(*feature, "val", F.when(F.col("_all") <= BINS, at).otherwise(
        F.floor(at * BINS / F.col("_all"))).cast("int").alias("bin")))


def binned_rows(p: Profiles) -> DataFrame:
    """Scored rows: cell, respondent, fold, y, bins (one per feature in their order; ABSENT at the target's place).

    Bins are looked up where the rows are, one small table per feature. With many features, or more answers than can be sent
    to every executor, rows are expanded by feature and put together by respondent.
    """
    found = feature_bins(p)
    if len(p.features) <= MOST_LOOKUPS and found.rows <= BROADCAST_ROWS and found.bytes <= BROADCAST_BYTES:
        rows = p.df.where(F.col("y").isNotNull()).select(*CELL, p.id_col, "fold", "y", "x")
        for i, name in enumerate(p.features):
            own = found.df.where(F.col("feature") == name).select(*CELL, F.col("val").alias("_val"), F.col("bin").alias(f"_b{i}"))
            rows = rows.withColumn("_val", F.get("x", F.lit(i))).join(F.broadcast(own), [*CELL, "_val"], "left").drop("_val")
        bins = [F.when(F.col("target") == name, ABSENT).otherwise(F.coalesce(f"_b{i}", F.lit(NONE))) for i, name in enumerate(p.features)]
        return rows.select(*CELL, p.id_col, "fold", "y", F.array(*bins).alias("bins"))
    rows = p.answers(p.by_respondent().select(*CELL, p.id_col, "fold", "y", "x"))
    rows = found.join_into(rows, [*CELL, "feature", "val"], "left", spread=p.id_col)
    pairs = F.collect_list(F.struct("i", F.coalesce("bin", F.lit(NONE)).alias("bin")))
    rows = rows.groupBy(*CELL, p.id_col, "fold", "y").agg(F.map_from_entries(pairs).alias("_bins"))
    return rows.withColumn("bins", F.transform(F.sequence(F.lit(0), F.lit(len(p.features) - 1)), lambda i: F.coalesce(F.try_element_at(
        "_bins", i), F.lit(ABSENT)))).drop("_bins")


def packed_blocks(p: Profiles, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Scored rows in blocks of about ``BLOCK_ANSWERS`` answers: cell, and per block the bytes of fold, y, bins and bags.

    A large cell is many blocks, dealt by respondent; neighbouring blocks are written together. ``bags`` tells per tree whether a row
    trains it.
    """
    n_features = len(p.features)
    cells = p.classes.df.groupBy(*CELL).agg(F.sum("n").alias("_n")).withColumn(
        "_blocks", F.greatest(F.lit(1), F.ceil(F.col("_n") * n_features / BLOCK_ANSWERS)))
    # one row per cell
    before = Window.orderBy(*CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("_first", F.coalesce(F.sum("_blocks").over(before), F.lit(0))))
    n_rows = cells.df.agg(F.sum("_blocks")).first()[0] or 0
    bagged = F.array(*[F.substring(seeded_key(seed, F.lit("b"), F.lit(t), F.col(p.id_col)), 1, 2) < SHARE for t in range(trees)])
    rows = cells.narrow(*CELL, "_blocks", "_first").join_into(binned_rows(p), CELL, spread=p.id_col).withColumn(
        "_block", F.col("_first") + F.pmod(F.xxhash64(p.id_col), F.col("_blocks"))).select(
        *CELL, "_block", F.floor(F.col("_block") / PACKED).alias("_part"), F.col("fold").cast("int"), F.col("y").cast("int"), "bins", bagged.alias("bags"))

    def pack(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        flat = lambda name, kind: np.asarray(block[name].combine_chunks().flatten().to_numpy(zero_copy_only=False), kind)
        n = block.num_rows
        by_row = {"bins": flat("bins", np.int8).reshape(n, n_features).T, "bags": flat("bags", np.bool_).reshape(n, trees).T,
                  "fold": block["fold"].to_numpy().astype(np.int16), "y": block["y"].to_numpy().astype(np.int32)}
        return pa.table({**{c: block[c].slice(0, 1) for c in CELL}, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in by_row.items()}}).select(
            [*CELL, "fold", "y", "bins", "bags"])
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // PACKED)
    schema = "target string, country string, fold binary, y binary, bins binary, bags binary"
    return materialize(rows.repartition(tasks, "_part").groupBy("_part", *CELL, "_block").applyInArrow(pack, schema)).df


class Block:
    """Rows of one cell, and the trees of the cell so far.

    ``splits`` are entries (slot, i, bin) and ``votes`` entries (slot, vote) of the cell's nodes; a node without one is a leaf, or says nothing.
    """

    def __init__(self, row: dict, n_features: int, n_folds: int, trees: int, depth: int) -> None:
        self.fold, self.y = np.frombuffer(row["fold"], np.int16), np.frombuffer(row["y"], np.int32).astype(np.int64)
        self.bins = np.frombuffer(row["bins"], np.int8).reshape(n_features, -1)
        self.bags = np.frombuffer(row["bags"], np.bool_).reshape(trees, -1)
        self.cell, self.n_folds, self.trees, self.nodes = (row["target"], row["country"]), n_folds, trees, 2 << depth
        slots = n_folds * trees * self.nodes
        self.feature, self.cut, self.vote = np.full(slots, -1), np.zeros(slots, np.int8), np.full(slots, -1)
        for s in row.get("splits") or ():
            self.feature[s["slot"]], self.cut[s["slot"]] = s["i"], s["bin"]
        for s in row.get("votes") or ():
            self.vote[s["slot"]] = s["vote"]

    def first_slot(self, f: int, t: int) -> int:
        return (f * self.trees + t) * self.nodes

    def walk(self, rows: np.ndarray, f: int, t: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Node of every row, and whether it was reached by a split on every level so far."""
        node, open_ = np.ones(len(rows), np.int64), np.ones(len(rows), bool)
        for _ in range(level):
            slot = node + self.first_slot(f, t)
            i = self.feature[slot]
            open_ &= i >= 0
            node = np.where(open_, 2 * node + (self.bins[i, rows] > self.cut[slot]), node)
        return node, open_

    def training(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Fold model, tree and the rows it is grown from: those of its bag in the other folds."""
        for t in range(self.trees):
            bag = np.flatnonzero(self.bags[t])
            for f in range(self.n_folds):
                yield f, t, bag[self.fold[bag] != f]

    def histograms(self, level: int, n_classes: int) -> Iterator[list[np.ndarray]]:
        """Columns f, t, node, i, bin, y, n of the nodes that ``level`` may split."""
        width = BINS - NONE
        places = {i: (b.astype(np.int64) - NONE) * n_classes for i, b in enumerate(self.bins) if len(b) and b[0] != ABSENT}
        for f, t, rows in self.training():
            node, open_ = self.walk(rows, f, t, level)
            rows, node = rows[open_], node[open_]
            at = (node - (1 << level)) * (width * n_classes) + self.y[rows]
            for i, place in places.items():
                n = np.bincount(at + place[rows])
                code = np.flatnonzero(n)
                part, y = np.divmod(code, n_classes)
                part, b = np.divmod(part, width)
                same = lambda v: np.full(len(code), v)
                yield [same(f), same(t), part + (1 << level), same(i), b + NONE, y, n[code]]

    def leaves(self, depth: int, n_classes: int) -> Iterator[list[np.ndarray]]:
        """Columns f, t, node, y, n after the last level."""
        for f, t, rows in self.training():
            n = np.bincount(self.walk(rows, f, t, depth)[0] * n_classes + self.y[rows])
            code = np.flatnonzero(n)
            yield [np.full(len(code), f), np.full(len(code), t), *np.divmod(code, n_classes), n[code]]

    def hits(self, depth: int, n_classes: int) -> Iterator[list[np.ndarray]]:
        """Columns fold, n_test, n_right: rows are tested by the trees of their own fold, the later class wins a tie."""
        for f in np.unique(self.fold):
            rows = np.flatnonzero(self.fold == f)
            votes = np.zeros((len(rows), n_classes), np.int64)
            for t in range(self.trees):
                said = self.vote[self.walk(rows, f, t, depth)[0] + self.first_slot(f, t)]
                given = np.flatnonzero(said >= 0)
                votes[given, said[given]] += 1
            pred = n_classes - 1 - votes[:, ::-1].argmax(axis=1)
            right = (pred == self.y[rows]) & votes.any(axis=1)
            yield [np.array([f]), np.array([len(rows)]), np.array([right.sum()])]


def counted(blocks: DataFrame, p: Profiles, trees: int, depth: int, columns: list[str], count) -> DataFrame:
    """Rows of ``count(block)`` for all blocks: cell and ``columns``, the last ones to be summed up over a cell's blocks."""
    n_features, n_folds = len(p.features), p.n_folds
    schema = ", ".join(["target string", "country string", *[f"{c} bigint" for c in columns]])

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], n_features, n_folds, trees, depth)
                for got in _gathered(count(block)):
                    n = len(got[0])
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(c), n) for c in block.cell], *[pa.array(c, pa.int64()) for c in got]], names=[*CELL, *columns])
    return blocks.mapInArrow(per_block, schema)


def _gathered(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Parts put together to about ``OUT_ROWS`` rows."""
    kept: list[list[np.ndarray]] = []
    n = 0
    for part in parts:
        kept.append(part)
        n += len(part[0])
        if n >= OUT_ROWS:
            yield [np.concatenate(c) for c in zip(*kept)]
            kept, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*kept)]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _best_split(bins: Column) -> Column:
    """Best split of an array of (bin, counts per class), sorted: struct of gain and bin (the last one on the left), or NULL.

    The gain is that of the Gini index times the rows: sum of squares over rows on both sides, less that of the node. One pass over
    the bins moves their counts from the right to the left side.
    """
    none = F.lit(0).cast("bigint")
    add = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: x + y)
    zeros = lambda xs: F.transform(xs, lambda x: none)

    def sides(left: Column, total: Column) -> Column:
        start = F.struct(*(none.alias(c) for c in ("nl", "sl", "nr", "sr")))
        both = F.zip_with(left, total, lambda l, t: F.struct(l.alias("l"), (t - l).alias("r")))
        return F.aggregate(both, start, lambda s, x: F.struct((s["nl"] + x["l"]).alias("nl"), (s["sl"] + x["l"] * x["l"]).alias("sl"),
                                                              (s["nr"] + x["r"]).alias("nr"), (s["sr"] + x["r"] * x["r"]).alias("sr")))

    def search(total: Column, whole: Column) -> Column:
        def step(seen: Column, b: Column) -> Column:
            def judged(left: Column) -> Column:
                def better(s: Column) -> Column:
                    gain = F.when((s["nl"] >= MIN_ROWS) & (s["nr"] >= MIN_ROWS), s["sl"].cast("double") / s["nl"] + s["sr"].cast("double") / s["nr"] - whole)
                    return _let(gain, lambda g: F.struct(left.alias("left"), F.when(g > seen["gain"], g).otherwise(seen["gain"]).alias("gain"),
                                                         F.when(g > seen["gain"], b["bin"]).otherwise(seen["bin"]).alias("bin")))
                return _let(sides(left, total), better)
            return _let(add(seen["left"], b["counts"]), judged)
        start = F.struct(zeros(total).alias("left"), F.lit(LEAST_GAIN).alias("gain"), F.lit(None).cast("int").alias("bin"))
        return F.aggregate(bins, start, step, lambda seen: F.when(seen["bin"].isNotNull(), F.struct(seen["gain"].alias("gain"), seen["bin"].alias("bin"))))
    first = zeros(F.get(bins, F.lit(0))["counts"])
    return _let(F.aggregate(bins, first, lambda s, b: add(s, b["counts"])), lambda total: _let(sides(total, total), lambda s: search(
        total, s["sl"].cast("double") / s["nl"])))


def _slot(trees: int, depth: int) -> Column:
    """Place of a node among the nodes of a cell's trees."""
    return ((F.col("f") * trees + F.col("t")) * (2 << depth) + F.col("node")).cast("int")


def grow(blocks: DataFrame, p: Profiles, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Materialized | None:
    """Splits of all trees: one row per cell with ``splits``, entries of slot, feature place and bin; nodes without one are leaves."""
    found: DataFrame | None = None
    book: Materialized | None = None
    node = [*CELL, "f", "t", "node"]
    classes = F.sequence(F.lit(0), F.lit(p.n_classes - 1))
    n_classes = p.n_classes
    for level in range(depth):
        at = blocks if book is None else book.join_into(blocks, CELL, "left")
        counts = counted(at, p, trees, depth, ["f", "t", "node", "i", "bin", "y", "n"], lambda b, level=level: b.histograms(level, n_classes))
        counts = counts.groupBy(*node, "i", "bin", "y").agg(F.sum("n").alias("n")).withColumns({c: F.col(c).cast("int") for c in ("i", "bin")})
        # at most one entry per class, then per bin
        dense = counts.groupBy(*node, "i", "bin").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), "n"))).alias("_n")).select(
            *node, "i", F.struct("bin", F.transform(classes, lambda c: F.coalesce(F.try_element_at("_n", c), F.lit(0))).alias("counts")).alias("b"))
        tried = dense.where(F.substring(seeded_key(seed, F.lit("f"), F.col("t"), F.col("node"), p.feature_name("i")), 1, 2) < SHARE)
        # few bytes, much work: a fixed number of tasks, as small shuffles would be merged into one
        tried = tried.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *node)
        splits = tried.groupBy(*node, "i").agg(_best_split(F.array_sort(F.collect_list("b"))).alias("s")).where("s IS NOT NULL")
        first = Window.partitionBy(*node).orderBy(F.desc("s.gain"), "i")  # features of one node
        splits = splits.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*node, "i", "s.bin")
        found = materialize(splits if found is None else found.unionByName(splits)).df
        book = materialize(found.groupBy(*CELL).agg(F.collect_list(F.struct(_slot(trees, depth).alias("slot"), "i", "bin")).alias("splits")))
    return book


def forest_grid(p: Profiles, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """Held-out accuracy of bagged trees per cell and fold: target, country, fold, n_test, n_right, accuracy.

    All features but the target take part. A leaf votes for its most frequent class, a forest for the class with most votes; the later class
    wins a tie. A node stays a leaf without a split that helps and leaves ``MIN_ROWS`` training rows on both sides. Where no other fold has rows
    nothing is right.
    """
    blocks = packed_blocks(p, trees, seed)
    book = grow(blocks, p, trees, depth, seed)
    n_classes = p.n_classes
    if book is not None:
        blocks = book.join_into(blocks, CELL, "left")
    node = [*CELL, "f", "t", "node"]
    sizes = counted(blocks, p, trees, depth, ["f", "t", "node", "y", "n"], lambda b: b.leaves(depth, n_classes))
    leaves = sizes.groupBy(*node, "y").agg(F.sum("n").alias("n")).groupBy(*node).agg(F.max(F.struct("n", "y"))["y"].alias("vote"))
    votes = materialize(leaves.groupBy(*CELL).agg(F.collect_list(F.struct(_slot(trees, depth).alias("slot"), "vote")).alias("votes")))
    tested = votes.join_into(blocks, CELL, "left")
    hits = counted(tested, p, trees, depth, ["fold", "n_test", "n_right"], lambda b: b.hits(depth, n_classes))
    out = hits.groupBy(*CELL, F.col("fold").cast("int").alias("fold")).agg(F.sum("n_test").alias("n_test"), F.sum("n_right").alias("n_right"))
    return out.withColumn("accuracy", F.col("n_right") / F.col("n_test"))
