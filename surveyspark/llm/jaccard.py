"""Jaccard join of documents on word shingles by token-combination prefixes.

Two sets with Jaccard similarity of at least ``share`` lack few of each other's
tokens: of the n tokens of one, the other misses at most ``e = n - ceil(share n)``.
Tokens are put in one global order. A set's prefix in it is indexed: rare tokens
as they are, frequent ones as combinations of two. A combination is lost when
either token is, so frequent tokens of one class count one less than
there are; the prefix is extended until what it holds exceeds ``e``. Then two
similar sets always have a rare token or a combination in common.

What keeps it small:

* Equal sets are one set from the start; only one of them is indexed and counts as a holder of its tokens.
* Tokens go to their counts packed: of a block of sets those that share a bucket of the hash range, with the number of their set in the
  block. Back come those that several sets hold. Neither ids nor texts move with them.
* The order begins with the tokens whose hash lies in a fixed part of the hash range
  (``Params.part``), rare ones first. Frequencies are only counted for tokens that a prefix can reach:
  those of that part or, for sets that have too few of them, all.
* Tokens that occur once are never indexed, and a set with more than ``e`` of them can't be similar to any other.
* Combinations are built inside small hash classes whose number follows the size of the set,
  so their number grows with the prefix, not with its square. Sets index under their own
  class of sizes and the next one, so that sets of similar size share the hash classes.
* Pairs are verified star by star: each index entry is compared with its most typical set first,
  which connects what belongs together with one comparison per set.
* What is still open, entries whose sets lie in several components, is compared inside clusters
  of sets that share open entries. A cluster is cut into blocks; each pair of blocks is a task, unless both
  lie in the cluster's largest component. Blocks are copied once per task, so they hold no texts but a parity bitmap
  of each set, with at least as many bits as the set has tokens: each differing bit is a token that one of two sets lacks, so
  two bitmaps that differ too much rule a pair out, and no link is lost. What is left is verified by texts in two rounds: the nearest
  candidate of each set, then those whose components are still apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.components import components
from surveyspark.llm.texts import Rolling, WordHash, discard, keyed, mixed, stored

# Occurrences beyond which a token is indexed in combinations only.
FREQUENT = 32
# Frequent tokens of one hash class, on average, in a prefix of such tokens only.
CLASS_TOKENS = 4
# Sets, and tokens, of one block of a cluster.
BLOCK_SETS, BLOCK_TOKENS = 2048, 1 << 21
# Tokens of a packet's block, and of one bucket of the counts.
PACKET_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS = 1 << 20, 1 << 21, 32


@dataclass(frozen=True)
class Params:
    """Words of a shingle; sets link at ``percent`` % similarity; part of the hash range that comes first (of 1000).

    Below 67 %, sets of two or three frequent shingles can have no combination to be indexed by.
    """

    words: int = 5
    percent: int = 80
    part: int = 330

    def __post_init__(self) -> None:
        if not 67 <= self.percent <= 100:
            raise ValueError("sets below 67 % similarity may share no index entry")

    def slack(self, n: int) -> int:
        """Tokens that a similar set may lack."""
        return n - -(-n * self.percent // 100)

    def alone(self, n: int) -> bool:
        """Is a set of this size similar to equal sets only? Without slack it may still lie in a larger one."""
        return not self.slack(n) and n * 100 // self.percent <= n

    def bounds(self) -> list[int]:
        """Smallest size of each class of sizes; similar sets are at most one class apart."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * 100 // self.percent + 1)
        return out

    def classes(self, bound: int) -> int:
        return max(1, self.slack(bound) // CLASS_TOKENS)


def shingles(text: bytes, words: int, known: WordHash, rolling: Rolling) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle."""
    hashes = known.all(text.lower().split())
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, words)
    prefix, first = rolling.prefix(hashes), np.arange(n - k + 1)
    out = rolling.stretch(prefix, first, first + k)
    return np.unique(out if n >= words else mixed(out + np.uint64(n)))


def _tools():
    return WordHash(), Rolling(0xA0761D6478BD642F)


def _spread(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(classes)).astype(np.int64)


def _reach(hashes: np.ndarray, classes: int) -> int:
    """What these tokens count for at least: all of them frequent."""
    return int(np.maximum(np.bincount(_spread(hashes, classes)) - 1, 0).sum()) if len(hashes) else 0


def _profiles(p: Params):
    edge = np.uint64((1 << 64) // 1000 * p.part)
    bounds = p.bounds()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = _tools()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                h = shingles(text.as_buffer().to_pybytes(), p.words, known, rolling)
                n, e = len(h), p.slack(len(h))
                zone, inside = h[:0], 0
                if n and not p.alone(n):
                    inside = int(np.searchsorted(h, edge))
                    c = int(np.searchsorted(bounds, n, "right")) - 1
                    enough = all(_reach(h[:inside], p.classes(bounds[i])) > e for i in (c, c + 1))
                    zone = h[:inside] if enough else h
                a = mixed(h ^ np.uint64(n))
                rows.append((n, int(a.sum(dtype=np.uint64)), int(mixed(a + np.uint64(7)).sum(dtype=np.uint64)), inside, zone))
            if rows:
                zones = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)),
                                                 pa.array(np.concatenate([r[4] for r in rows]).view(np.int64)))
                signed = [pa.array(np.array([r[i] for r in rows], np.uint64).view(np.int64)) for i in range(4)]
                yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "th", "row")), *signed, pa.array([len(r[4]) for r in rows], pa.int64()), zones],
                                      names=["doc_id", "th", "row", "n", "d1", "d2", "inside", "size", "zone"])
    return run


def _grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``key``, by which the batches are sorted, as one batch."""
    value, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and keys[lo] != value:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                value = keys[lo]
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packets(buckets: int):
    """Of blocks of consecutive rows, the tokens that share a bucket: hashes, whose they are (``at`` points into ``sets``, that to the
    row in the block) and the digests of those sets. ``heads``, sizes of all sets of the block, go with the first packet.
    """
    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, size = (batch.column(c).to_numpy() for c in ("row", "size"))
        apart = np.diff(row) != 1
        piece = np.cumsum(size) // PACKET_TOKENS
        cuts = [0, *(np.flatnonzero(apart | (np.diff(piece) > 0)) + 1).tolist(), len(row)]
        for lo, hi in zip(cuts, cuts[1:]):
            for first in range(lo, hi, 1 << 16):
                yield batch.slice(first, min(hi, first + (1 << 16)) - first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in blocks(batch)):
            n, d1, d2, size = (block.column(c).to_numpy() for c in ("n", "d1", "d2", "size"))
            new = np.zeros(len(n), bool)
            new[np.unique(np.stack((n, d1, d2)), axis=1, return_index=True)[1]] = True
            at = np.repeat(np.arange(len(n)), size)
            h = block.column("zone").flatten().to_numpy().view(np.uint64)
            h, at = h[new[at]], at[new[at]]
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, at, bucket = h[order], at[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(h)]
            heads, out = np.stack([block.column(c).to_numpy() for c in ("n", "inside", "size")]).tobytes(), []
            for lo, hi in zip(cuts, cuts[1:]):
                sets, own = np.unique(at[lo:hi], return_inverse=True)
                out.append((int(bucket[lo]), block.column("row")[0].as_py(), own.astype(np.uint16).tobytes(), h[lo:hi].tobytes(),
                            sets.astype(np.uint16).tobytes(), d1[sets].tobytes(), None if out else heads))
            for first in range(0, len(out), 64):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[first:first + 64]), PACKET.values())], names=list(PACKET))
    return run


PACKET = {"bucket": pa.int32(), "block": pa.int64(), "at": pa.binary(), "h": pa.binary(), "sets": pa.binary(), "digests": pa.binary(), "heads": pa.binary()}
PACKETS = "bucket int, block bigint, at binary, h binary, sets binary, digests binary, heads binary"
REPLIES = "block bigint, at binary, h binary, df binary, heads binary"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each packet (sorted by ``bucket``) its tokens that several sets hold, with their number; of equal sets the first row has them."""
    for bucket in _grouped(batches, "bucket"):
        bucket = bucket.take(pa.array(np.argsort(bucket.column("block").to_numpy(), kind="stable")))
        parts = {c: [np.frombuffer(x.as_buffer(), t) for x in bucket.column(c)] for c, t in (
            ("at", np.uint16), ("h", np.uint64), ("sets", np.uint16), ("digests", np.int64))}
        h, digest = np.concatenate(parts["h"]), np.concatenate([d[a] for d, a in zip(parts["digests"], parts["at"])])
        at = np.concatenate([s[a] for s, a in zip(parts["sets"], parts["at"])])
        packet = np.repeat(np.arange(len(parts["h"])), [len(x) for x in parts["h"]])
        order = np.lexsort((digest, h))
        hs, ds = h[order], digest[order]
        token = np.ones(len(hs), bool)
        token[1:] = hs[1:] != hs[:-1]
        holder = token.copy()
        holder[1:] |= ds[1:] != ds[:-1]
        number = np.cumsum(token) - 1
        df = np.bincount(number[holder])[number]
        kept = holder & (df > 1)
        order, df = order[kept], df[kept].astype(np.int32)
        back = np.argsort(order)
        order, df = order[back], df[back]
        edges = np.searchsorted(packet[order], np.arange(len(parts["h"]) + 1)).tolist()
        at, h = at[order], h[order]
        rows = [(block, at[lo:hi].tobytes(), h[lo:hi].tobytes(), df[lo:hi].tobytes(), heads) for block, heads, lo, hi in zip(
            bucket.column("block").to_pylist(), bucket.column("heads").to_pylist(), edges, edges[1:]) if hi > lo or heads is not None]
        for first in range(0, len(rows), 64):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[first:first + 64]), (pa.int64(), *[pa.binary()] * 4))],
                                  names=["block", "at", "h", "df", "heads"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with their tokens that others hold too, from the replies (sorted by ``block``); a set's node is the number of its row."""
    for block in _grouped(batches, "block"):
        at, h, df = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in block.column(c)]) for c, t in (
            ("at", np.uint16), ("h", np.int64), ("df", np.int32)))
        n, inside, size = np.frombuffer(next(x.as_buffer() for x in block.column("heads") if x.is_valid), np.int64).reshape(3, -1)
        order = np.argsort(at, kind="stable")
        sets, first = np.unique(at[order], return_index=True)
        if len(sets):
            tokens = pa.StructArray.from_arrays([pa.array(h[order]), pa.array(df[order].astype(np.int64))], names=["h", "df"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), tokens)
            yield pa.record_batch([pa.array(sets.astype(np.int64) + block.column("block")[0].as_py()), *(pa.array(x[sets]) for x in (n, inside, size)), lists],
                                  names=["node", "n", "inside", "size", "tokens"])


def _index(p: Params):
    """Index entries of a set, from its tokens that occur more than once."""
    edge, bounds = np.uint64((1 << 64) // 1000 * p.part), p.bounds()

    def entries(h: np.ndarray, df: np.ndarray, n: int, once: tuple[int, int], c: int) -> np.ndarray:
        need, classes, salt = p.slack(n) + 1, p.classes(bounds[c]), np.uint64(2 * c)
        out = []
        for part, alone in ((h < edge, once[0]), (h >= edge, once[1])):
            need -= alone
            if need <= 0:
                break
            rare = np.sort(h[part & (df <= FREQUENT)])[:need]
            out.append(mixed(mixed(rare) + salt))
            need -= len(rare)
            if need <= 0:
                break
            often = np.sort(h[part & (df > FREQUENT)])
            held: dict[int, list] = {}
            for token, kind in zip(often, _spread(often, classes).tolist()):
                others = held.setdefault(kind, [])
                if others:
                    out.append(mixed(mixed(np.array(others)) * np.uint64(3) + mixed(token) + salt + np.uint64(1)))
                    need -= 1
                others.append(token)
                if need <= 0:
                    break
            if need <= 0:
                break
        return np.concatenate(out) if out else h[:0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sigs = [], []
            tokens = batch.column("tokens")
            for i, (n, inside, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "inside", "size")))):
                own = tokens[i].values
                h = own.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
                df = own.field("df").to_numpy(zero_copy_only=False)
                near = int((h < edge).sum())
                c = int(np.searchsorted(bounds, n, "right")) - 1
                got = np.unique(np.concatenate([entries(h, df, n, (inside - near, size - inside - len(h) + near) if size > inside
                                                        else (inside - near, 0), k) for k in (c, c + 1)]))
                typical = float(np.log(df).sum() / size)
                sigs.append(got.view(np.int64))
                rows += [(i, typical)] * len(got)
            if rows:
                where = pa.array([r[0] for r in rows])
                yield pa.record_batch([pa.array(np.concatenate(sigs)), batch.column("node").take(where), batch.column("n").take(where),
                                       pa.array([r[1] for r in rows])], names=["sig", "node", "n", "typical"])
    return run


def _verify(p: Params):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = _tools()
        recent: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[text] = shingles(text, p.words, known, rolling)
            return recent[text]

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= p.percent * (len(a) + len(b) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _node() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _links(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda node, text: texts.select(F.col("node").alias(node), F.col("text").alias(text))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    node = pairs.schema["a"].dataType
    return joined.select("a", "b", "x", "y").mapInArrow(_verify(p), T.StructType([T.StructField("a", node), T.StructField("b", node)]))


def _bitmaps(p: Params):
    """Parity of the number of tokens at each bit; at least as many bits as tokens."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = _tools()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                h = shingles(text.as_buffer().to_pybytes(), p.words, known, rolling)
                bits = max(64, 1 << (len(h) - 1).bit_length())
                out.append(np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes())
            yield pa.record_batch([*(batch.column(c) for c in ("node", "n", "root", "cluster")), pa.array(out, pa.binary())],
                                  names=["node", "n", "root", "cluster", "bits"])
    return run


def _near_blocks(p: Params):
    """Pairs of each two blocks (rows sorted by ``task``) that lie in different components and may be links."""
    def near(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, root, k, other = (block.column(c).to_numpy() for c in ("n", "root", "k", "other"))
        maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("bits")]
        words = np.array([len(m) for m in maps])
        # Pairs inside a block belong to the first task that it meets.
        inner = other == (k == 0)
        order = np.argsort(n, kind="stable")
        for width in np.unique(words).tolist():
            same, wider = order[words[order] == width], order[words[order] == 2 * width]
            own = np.stack([maps[i] for i in same])
            # Halves of a parity bitmap add up to the one of half the width.
            folded = np.stack([maps[i][:width] ^ maps[i][width:] for i in wider]) if len(wider) else own[:0]
            for x, i in enumerate(same.tolist()):
                for rows, bits, lo in ((same, own, x + 1), (wider, folded, 0)):
                    hi = int(np.searchsorted(n[rows], n[i] * 100 // p.percent, "right"))
                    if hi > lo:
                        j = rows[lo:hi]
                        least = np.bitwise_count(bits[lo:hi] ^ own[x]).sum(axis=1, dtype=np.int64)
                        ok = ((100 + p.percent) * least <= (100 - p.percent) * (n[j] + n[i])) & (root[j] != root[i]) & ((k[j] != k[i]) | inner[i])
                        if ok.any():
                            yield np.full(int(ok.sum()), i), j[ok], least[ok]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, "task"):
            if len(set(block.column("root").to_pylist())) > 1:
                for i, j, least in near(block):
                    yield pa.record_batch([pa.array(x) for x in (*(block.column(c).to_numpy()[y] for c in ("node", "root") for y in (i, j)), least)],
                                          names=["a", "b", "x", "y", "least"])
    return run


def _candidates(left: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs a, b (roots x, y) that may be links among sets that share an open entry (hub, node, n, root); ``least`` tokens set them apart."""
    clusters = stored(components(left.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "cluster"), "clusters")
    members = left.select("node", "n", "root").distinct().join(clusters, "node")
    members = stored(members.join(texts, "node").mapInArrow(
        _bitmaps(p), "node bigint, n bigint, root bigint, cluster bigint, bits binary").dropDuplicates(["node"]), "members")
    parts = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    blocks = lambda c, t: F.ceil(F.greatest(c / BLOCK_SETS, t / BLOCK_TOKENS)).cast("int")
    plan = parts.groupBy("cluster").agg(F.max(F.struct("c", "t", "root")).alias("main"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    plan = stored(plan.select("cluster", F.col("main.root").alias("main"), blocks(F.col("main.c"), F.col("main.t")).alias("q"),
                              blocks(F.col("c") - F.col("main.c"), F.col("t") - F.col("main.t")).alias("p")), "plan")
    draw = F.xxhash64(F.lit("block"), "node")
    rows = members.join(plan, "cluster").filter("p > 0").withColumn("k", F.when(F.col("root") == F.col("main"), F.col("p") + F.pmod(draw, F.col("q")))
                                                                    .otherwise(F.pmod(draw, F.col("p"))).cast("int"))
    # A block meets the others; blocks of the largest component don't meet each other.
    meets = F.when(F.col("k") < F.col("p"), F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") - 1))
    rows = rows.withColumn("other", F.explode(meets)).filter("other <> k").select(
        F.xxhash64("cluster", F.least("other", "k"), F.greatest("other", "k")).alias("task"), "node", "n", "root", "k", "other", "bits")
    rows = rows.repartition("task").sortWithinPartitions("task")
    found = stored(rows.mapInArrow(_near_blocks(p), "a bigint, b bigint, x bigint, y bigint, least bigint"), "candidates")
    discard(clusters, members, plan)
    return found


def _joined(left: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """node, root: roots that links among sets with an open entry in common join to smaller ones."""
    near = _candidates(left, texts, p)
    ends = lambda pairs, links: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y").join(
        links, ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    sides = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"), "least"))
    nearest = sides.groupBy("a").agg(F.min(F.struct("least", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    tried = stored(_unordered(nearest), "tried")
    found = stored(_links(tried, texts, p), "nearest")
    first = stored(ends(near, found), "first")
    one = stored(components(first), "one")
    root = lambda side, last: one.select(F.col("node").alias(side), F.col("root").alias(last))
    apart = near.join(root("x", "_x"), "x", "left").join(root("y", "_y"), "y", "left").filter("coalesce(_x, x) <> coalesce(_y, y)")
    rest = stored(_unordered(apart).join(tried, ["a", "b"], "left_anti"), "rest")
    others = stored(_links(rest, texts, p), "others")
    second = stored(ends(near, others), "second")
    out = components(first.unionByName(second))
    discard(near, tried, found, first, one, rest, others, second)
    return out


def join(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Texts with fewer words than a shingle are one shingle; empty and null texts
    have none and stay alone. Ties and repeated rows are one set. Rows without
    doc_id take part; a component of such rows only has a null id. An empty table gives
    no rows; other columns are not read.
    """
    return _classes(docs, params or Params()).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(
        F.col("root.doc_id"), F.col("doc_id")).alias("component_id"))


def _entries(texts: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, th, n, d1, d2), the different sets (n, d1, d2, their node and the first of their rows) and the sets' index entries."""
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    profiles = stored(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_profiles(p), T.StructType([
        texts.schema["doc_id"], *longs("th", "row", "n", "d1", "d2", "inside", "size"), T.StructField("zone", T.ArrayType(T.LongType()))])), "profiles")
    rows = stored(profiles.select("doc_id", "th", "row", "n", "d1", "d2"), "rows")
    sets = stored(rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("node"), F.min(_node()).alias("first")), "sets")
    tokens = profiles.agg(F.sum("size")).first()[0] or 0
    packets = profiles.mapInArrow(_packets(max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))), PACKETS)
    replies = packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, REPLIES)
    entries = _index(p)
    index = replies.repartition("block").sortWithinPartitions("block").mapInArrow(
        lambda batches: entries(_shared(batches)), "sig bigint, node bigint, n bigint, typical double")
    index = stored(index, "index")
    discard(profiles)
    return rows, sets, index


def _classes(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, th, n and root (the smallest node of the component; null for texts without words) of each row."""
    texts = keyed(docs)
    rows, sets, index = _entries(texts, p)
    # Written before the join: Spark splits a hot entry only where both sides come from a shuffle.
    crowded = stored(index.groupBy("sig").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("sig"), "entries")
    every, index = index, stored(index.join(crowded, "sig", "left_semi"), "crowded")
    discard(every, crowded)
    nodes = sets.join(index.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("_doc"), F.col("first.th").alias("_th"))
    wanted = stored(texts.join(nodes, F.expr("doc_id <=> _doc AND th = _th")).select("node", "text"), "wanted")
    hubs = stored(index.groupBy("sig").agg(F.max(F.struct("typical", "node", "n")).alias("h")), "hubs")
    stars = index.join(hubs, "sig").filter(f"100 * least(n, h.n) >= {p.percent} * greatest(n, h.n)").select(
        F.col("node").alias("a"), F.col("h.node").alias("b"))
    roots = stored(components(_links(_unordered(stars), wanted, p)), "roots")
    discard(hubs)
    entries = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = stored(entries.groupBy("sig").agg(F.min("node").alias("hub"), (F.min("root") < F.max("root")).alias("_open"))
                     .filter("_open").select("sig", "hub"), "several")
    left = stored(entries.join(several, "sig").select("hub", "node", "n", "root").distinct(), "open")
    discard(index, several)
    # Only roots that a link joins to others change.
    joined = stored(_joined(left, wanted, p).select(F.col("node").alias("root"), F.col("root").alias("_last")), "joined")
    discard(wanted, left)
    last = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left").select(
        "n", "d1", "d2", "first", F.coalesce("_last", "root").alias("_last"))
    smallest = last.groupBy("_last").agg(F.min("first").alias("root"))
    return rows.join(last.join(smallest, "_last").drop("first"), ["n", "d1", "d2"], "left").select("doc_id", "th", "n", "root")


def deduplicate(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: per component the smallest doc_id, and all documents without words.

    Of different texts under one doc_id, or without doc_id, the one with the smallest digest stays;
    rows that repeat a doc_id and its text are one document and stay together.
    """
    out = _classes(docs.select("doc_id", "text"), params or Params())
    gone = out.filter("root IS NOT NULL").filter(_node() != F.col("root")).select(
        F.col("doc_id").alias("__jaccard_doc"), F.col("th").alias("__jaccard_th")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__jaccard_doc")) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__jaccard_th")), "left_anti")
