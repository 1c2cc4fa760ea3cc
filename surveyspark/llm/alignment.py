"""Alignment of two tokenizers' tokens by diagonal run skipping, and corpus-wide counts of aligned pairs.

Both tokenizers cut the same bytes. Their tokens are given by end offsets, two
rising arrays that share their last value. Where token i of one and token
i + shift of the other end together, and so do the next ones, the two run
along a diagonal; probes of doubling length compare the arrays at the
current shift and jump over such stretches. Where they part, the side that lags is advanced
until both ends meet again, which closes an irregular group and sets a new shift.
Each step along the way is a link: a pair of tokens that share bytes.

Texts are cut at single spaces between other characters before they are
encoded. Neither tokenizer has a token across such a place (the first cuts
words there, and no piece of the second holds a space behind another character;
this is checked when it is loaded), so the tokens are those of the whole text, and words
that come again are looked up. The alignment runs over whole texts.

Pair counts. A task cuts its documents into chunks; the different pairs of a chunk
and in how many of its documents they occur are added up over the corpus, and the totals go back
to the chunks. So a pair is shuffled once per chunk that holds it, not once per document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from surveyspark.llm.texts import stored

# Links, and documents, after which a chunk is closed; words a worker remembers; characters of texts, and words, taken at a time.
CHUNK_LINKS, CHUNK_DOCS, MEMORY, BATCH_CHARS, BLOCK_WORDS = 1 << 21, 4096, 900_000, 1 << 18, 2000
# Pairs are one number: first id times this, plus the second id.
WIDE = 1 << 24
# A space where both tokenizers cut: no white space, nor what one of them may take for it, on either side.
_NARROW = "\u180e\u200b\u2060\ufeff\u2581"
_OTHER = rf"[^\s{_NARROW}]"
CUT = re.compile(rf"(?<={_OTHER}) (?={_OTHER})")
MARK = "▁"
# Fixed value: how the byte-level vocabulary parts a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words of Latin letters, digits and signs, whose classes are the same in every version of Unicode.
PLAIN = re.compile("[!-~\u00a1-\u024f]+")
DEFAULT_DIR = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"


def joins(word: str) -> bool:
    """Can a word stand between others in one text, cut at its edges as in any other?"""
    first, last = word[:1], word[-1:]
    return word != "" and not (first.isspace() or last.isspace() or first in _NARROW or last in _NARROW)


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Ids of words that are preceded by a space, and the bytes of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], plain: Callable[[str], list[int]] | None = None) -> None:
        self.encode, self.tokens = encode, tokens
        # A faster way for texts of plain words, with the same result.
        self.plain = plain or (lambda text: encode([text])[0])
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.names = np.array([str(i) for i in range(len(tokens))], object)
        self.bars = self.names + "|"

    def encode_words(self, words: list[str], plain: bool) -> list[bytes] | None:
        """Ids of each word as bytes, from all words as one text; none if its tokens don't spell it."""
        text = " ".join(words)
        ids = self.plain(text) if plain else self.encode([text])[0]
        if not self.spells(ids, text):
            return None
        ids = np.array(ids, "<i4")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        edges, data = (4 * ends).tolist(), ids.tobytes()
        return [data[lo:hi] for lo, hi in zip([0, *edges], edges)]

    def spells(self, ids: Iterable[int], text: str) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == b" " + text.encode()


def byte_coder(path: str) -> Coder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    alphabet = byte_alphabet()
    names = map(model.id_to_token, range(model.get_vocab_size()))
    tokens = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
    return Coder(lambda words: [e.ids for e in model.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], tokens, _ranked(path, alphabet))


def _ranked(path: str, alphabet: dict[str, int]) -> Callable[[str], list[int]] | None:
    """Encoder of plain words by the vocabulary's ranks, if the file's merges are in the order of their ids."""
    import tiktoken
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, cut = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or spec["normalizer"] or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
        return None
    ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if all(c in alphabet for c in t)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
    coder = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: coder.encode_ordinary(" " + text)


def piece_coder(path: str) -> Coder:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a space behind another character, so texts can't be cut at spaces")
    hexa = re.compile(r"<0x([0-9A-F]{2})>")
    tokens = []
    for i, piece in enumerate(pieces):
        code = hexa.fullmatch(piece) if model.is_byte(i) else None
        tokens.append(bytes([int(code[1], 16)]) if code else piece.replace(MARK, " ").encode())
    return Coder(lambda words: model.encode(words, num_threads=1), tokens)


class Words:
    """Ids of words under both coders, as bytes of 32-bit numbers; emptied when full, so that its memory is bounded."""

    def __init__(self, first: Coder, second: Coder) -> None:
        self.coders, self.known, self.odd = (first, second), {}, set()

    def learn(self, cuts: list[list[str]]) -> None:
        new = list(set().union(*cuts).difference(self.known))
        if new and len(self.known) + len(new) > MEMORY:
            self.known, self.odd = {}, set()
            new = list(set().union(*cuts))
        plain = set(filter(PLAIN.fullmatch, new))
        inner = [w for w in new if w not in plain and joins(w)]
        rest = [w for w in new if w not in plain and not joins(w)]
        for words, kind in ((list(plain), "plain"), (inner, "inner"), (rest, "rest")):
            for lo in range(0, len(words), BLOCK_WORDS):
                self._learn(words[lo: lo + BLOCK_WORDS], kind)

    def _learn(self, new: list[str], kind: str) -> None:
        sides = []
        for coder in self.coders:
            ids = coder.encode_words(new, kind == "plain") if kind != "rest" else None
            if ids is None:
                each = coder.encode(new)
                self.odd.update(word for word, x in zip(new, each) if not coder.spells(x, word))
                ids = [np.array(x, "<i4").tobytes() for x in each]
            sides.append(ids)
        self.known.update(zip(new, zip(*sides)))

    def ids(self, words: list[str], text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; none if one of them doesn't spell the text."""
        both = tuple(np.frombuffer(b"".join(x), "<i4") for x in zip(*map(self.known.__getitem__, words)))
        if self.odd and not self.odd.isdisjoint(words) and not all(c.spells(x, text) for c, x in zip(self.coders, both)):
            return None
        return both


@lru_cache(maxsize=2)
def _words(first: str, second: str) -> Words:
    """Kept by the worker process from task to task."""
    return Words(byte_coder(first), piece_coder(second))


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """Stretches and links of two arrays of end offsets.

    A stretch is a row (first, end) on side a and (first, end) on side b: as many groups of one token each where both have the same
    length and ends, else one irregular group. The links of irregular groups are given as indexes of both sides.
    """
    stretches, links_a, links_b = [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        begin, start = i, j
        if a[i] == b[j]:
            shift, step = j - i, 4
            i += 1
            # Probes double while whole stretches agree at this shift, then halve; the last few are looked at one by one.
            while i < n and a[i: i + step] == b[i + shift: i + shift + step]:
                i += step
                step *= 2
            while step > 4:
                step //= 2
                if a[i: i + step] == b[i + shift: i + shift + step]:
                    i += step
            while i < n and a[i] == b[i + shift]:
                i += 1
            i = min(i, n)
            j = i + shift
        else:
            x, y = a[i], b[j]
            links_a.append(i)
            links_b.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                links_a.append(i)
                links_b.append(j)
            i += 1
            j += 1
        stretches += (begin, i, start, j)
    return np.array(stretches, np.int64).reshape(-1, 4), links_a, links_b


def straight(a: np.ndarray, b: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Which stretches are runs of one-to-one groups? Irregular ones differ in their first end or in their lengths."""
    i, p, j, q = stretches.T
    return (p - i == q - j) & (a[i] == b[j])


def grouped(a: list[str], bars: list[str], b: list[str], stretches: np.ndarray, regular: np.ndarray) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``; ``bars`` are side a's names with a bar behind."""
    out = []
    for i, p, j, q, even in zip(*stretches.T.tolist(), regular.tolist()):
        out.append(";".join(map(add, bars[i:p], b[j:q])) if even else f"{','.join(a[i:p])}|{','.join(b[j:q])}")
    return ";".join(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def packed(numbers: np.ndarray) -> bytes:
    width = 1 if not len(numbers) or numbers.max() < 1 << 8 else 2 if numbers.max() < 1 << 16 else 4
    return bytes([width]) + zlib.compress(numbers.astype(f"<u{width}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


LONGS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(first: str, second: str, id_type: pa.DataType):
    """Rows of two kinds: 0 for a chunk's pairs and their numbers of documents, 1 for a document and the places of its pairs."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", id_type), *((c, pa.int64()) for c in LONGS),
                        ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()),
                        ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = _words(first, second), TaskContext.get().partitionId(), 0
        one, two = known.coders
        rows, links = [], 0

        def document(doc_id, text: str | None, words_: list[str]) -> int:
            row = {"doc_id": doc_id, **dict.fromkeys(LONGS, 0), "groups_sha256": "", "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
            rows.append(row)
            both = known.ids(words_, text) if text else None
            if both is None:
                return 0
            a, b = both
            ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
            stretches, links_a, links_b = align(ends_a.tolist(), ends_b.tolist())
            regular = straight(ends_a, ends_b, stretches)
            said = grouped(one.names[a].tolist(), one.bars[a].tolist(), two.names[b].tolist(), stretches, regular)
            runs = stretches[regular]
            sizes = runs[:, 1] - runs[:, 0]
            links_a, links_b = (np.concatenate([np.array(x, np.int64), _ranges(runs[:, k], sizes)]) for k, x in ((0, links_a), (2, links_b)))
            pairs, times = np.unique(a[links_a] * np.int64(WIDE) + b[links_b], return_counts=True)
            row |= {"n_a": len(a), "n_b": len(b), "n_groups": int(sizes.sum()) + len(stretches) - len(runs), "n_links": len(links_a),
                    "pairs": pairs, "times": times, "groups_sha256": hashlib.sha256(said.encode()).hexdigest()}
            return len(links_a)

        def close() -> pa.RecordBatch:
            nonlocal number
            pairs, places, docs = np.unique(np.concatenate([r["pairs"] for r in rows]), return_inverse=True, return_counts=True)
            chunk, at, out = (part << 32) + number, 0, []
            number += 1
            for r in rows:
                own = places[at: at + len(r["pairs"])]  # rising, so kept as steps
                at += len(own)
                out.append(r | {"chunk": chunk, "kind": 1, "places": packed(np.diff(own, prepend=0)), "times": packed(r["times"]), "pairs": None})
            out.append({"chunk": chunk, "kind": 0, "pairs": pairs, "docs": docs})
            rows.clear()
            return pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in out], f.type) for f in schema})

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            lo = 0
            while lo < len(ids):
                held, cuts, chars = [], [], 0
                while lo + len(held) < len(ids) and chars < BATCH_CHARS:
                    text = texts[lo + len(held)].as_py()
                    held.append(text)
                    cuts.append(CUT.split(text) if text else [])
                    chars += len(text or "")
                known.learn(cuts)
                for k, text in enumerate(held):
                    links += document(ids[lo + k], text, cuts[k])
                    if links >= CHUNK_LINKS or len(rows) >= CHUNK_DOCS:
                        yield close()
                        links = 0
                lo += len(held)
        if rows:
            yield close()
    return run


def _scored(id_type: pa.DataType):
    """Documents with their counts, from rows sorted by chunk, kind and place; one chunk's totals are held at a time."""
    schema = pa.schema([("doc_id", id_type), *((c, pa.int64()) for c in (*LONGS, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, totals, best, parts = None, None, None, []
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(chunks)]
            out = []
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if chunks[lo] != chunk:
                    chunk, totals, parts = chunks[lo], None, []
                piece = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    parts.append((piece.column("total").to_numpy(), piece.column("best").to_numpy(zero_copy_only=False)))
                    continue
                if totals is None:
                    totals, best = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
                for row in piece.select(["doc_id", *LONGS, "groups_sha256", "places", "times"]).to_pylist():
                    own, times = np.cumsum(unpacked(row.pop("places"))), unpacked(row.pop("times"))
                    out.append(row | {"n_best": int(times[best[own].astype(bool)].sum()), "count_sum": int((times * totals[own]).sum())})
            if out:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in out], schema)
    return run


def align_corpus(docs: DataFrame, folder: str = DEFAULT_DIR, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` and ``second`` are files in ``folder``, which every executor holds. A null or empty text, or one
    whose tokens don't spell it (as where it holds the second tokenizer's mark for a space), has no
    tokens: zeros and an empty digest. Repeated rows count as documents of their own; of
    equally frequent partners all are best. An empty table gives no rows; other columns are not read.
    """
    id_field = docs.schema["doc_id"]
    arrow = to_arrow_type(id_field.dataType)
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    array = T.ArrayType(T.LongType())
    rows = stored(docs.select("doc_id", "text").mapInArrow(_aligned(f"{folder}/{first}", f"{folder}/{second}", arrow), T.StructType([
        *longs("chunk"), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", id_field.dataType), *longs(*LONGS),
        T.StructField("groups_sha256", T.StringType()), T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("pairs", array), T.StructField("docs", array)])), "aligned")
    pairs = rows.filter("kind = 0").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select(
        "chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    totals = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("total")), "totals")
    a = F.floor(F.col("pair") / F.lit(WIDE)).alias("a")
    most = totals.groupBy(a).agg(F.max("total").alias("most"))  # one row per id of the first vocabulary
    totals = totals.withColumn("a", a).join(most, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    known = pairs.join(totals, "pair").select("chunk", F.lit(0).alias("kind"), "place", "total", "best")
    mine = rows.filter("kind = 1").select("chunk", "kind", F.lit(0).alias("place"), "doc_id", *LONGS, "groups_sha256", "places", "times")
    both = known.unionByName(mine, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind", "place")
    return both.mapInArrow(_scored(arrow), T.StructType([
        T.StructField("doc_id", id_field.dataType), *longs(*LONGS, "n_best", "count_sum"), T.StructField("groups_sha256", T.StringType())]))
