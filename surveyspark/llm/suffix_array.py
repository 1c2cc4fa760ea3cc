"""Repeated byte strings by suffix arrays, sorted in two stages.

Shards of text that share an anchor (see ``repeats``) are sorted together. Of
all suffixes only those smaller than their successor are sorted directly; the
others follow from a scan over the buckets of first bytes: a suffix larger than
its successor is its first byte before a suffix that already has its place. The
common prefix of each suffix with the one before it then tells which windows
repeat. Suffixes are compared up to the window length, which is all that is asked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import repeats
from surveyspark.llm.texts import keyed

WINDOW = 400
GRAM = 48
# Larger than any byte of UTF-8.
END = 0xFF
STEP = 8


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts like them."""
    padded = np.concatenate((text, np.full(STEP, END, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, STEP)[: len(text)].copy().view(">u8").ravel().astype(np.uint64)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than the suffix one further on?"""
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(256)))
    places = np.where(step != 0, np.arange(len(text)), len(text))
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    return step[np.minimum(nearest, len(text) - 1)] > 0


def direct_sort(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """``suffixes`` in order of their first ``depth`` bytes; ties stay in order of place.

    Refines groups of equal prefixes eight bytes at a time. A group whose
    members agree on the next eight bytes is only looked at, not sorted.
    """
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    keys = words[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    at = np.flatnonzero(sizes[group] > 1)  # places in order that are still tied
    group = group[at]
    limit = len(words) - 1
    for off in range(STEP, depth, STEP):
        if not len(at):
            break
        keys = words[np.minimum(order[at] + off, limit)]
        if depth - off < STEP:
            keys = keys >> np.uint64(8 * (STEP - depth + off))
        first = np.concatenate(([True], group[1:] != group[:-1]))
        begin = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        differs = keys != keys[begin][number]
        mixed = np.zeros(len(begin), bool)
        mixed[number[differs]] = True
        some = np.flatnonzero(mixed[number])
        if not len(some):
            continue
        sub = some[np.lexsort((keys[some], number[some]))]
        moved, keys[some] = order[at[sub]], keys[sub]
        order[at[some]] = moved
        first[1:] |= keys[1:] != keys[:-1]
        number = np.cumsum(first) - 1
        keep = np.bincount(number)[number] > 1
        at, group = at[keep], number[keep]
    return order


def suffix_array(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Wanted suffixes in order of their first ``depth`` bytes.

    ``wanted`` marks places; ``starts`` marks the first place of each text,
    beyond which nothing is induced.
    """
    small = smaller_than_next(text)
    # A larger suffix needs its successor: wanted places reach on to the next smaller suffix.
    nearest = np.minimum.accumulate(np.where(small, np.arange(len(text)), len(text))[::-1])[::-1]
    ends = np.zeros(len(text), bool)
    ends[nearest[wanted]] = True
    # The last smaller suffix may lie beyond the wanted places; what leads to it is wanted too.
    last = np.maximum.accumulate(np.where(wanted, np.arange(len(text)), -1))
    need = wanted | ((last >= 0) & (nearest[last] >= np.arange(len(text))))
    need |= ends
    direct = direct_sort(words, np.flatnonzero(need & small), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced = need & ~small
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(some: np.ndarray) -> np.ndarray:
        """Places just before ``some`` that are to be induced."""
        some = some[~starts[some]] - 1
        return some[induced[some]]

    def deal(some: np.ndarray) -> None:
        first = text[some]
        by = np.argsort(first, kind="stable")
        some, first = some[by], first[by]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(some, cuts):
            if len(part):
                larger[text[part[0]]].append(part)

    for c in range(256):
        while larger[c]:
            wave = np.concatenate(larger[c])
            larger[c] = []
            out.append(wave)
            deal(before(wave))
        mine = direct[bounds[c]: bounds[c + 1]]
        out.append(mine)
        deal(before(mine))
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the prefix that each suffix in ``order`` shares with the one before, up to ``depth``.

    Pairs are compared eight bytes at a time and leave at their first difference.
    """
    out = np.full(len(order), depth, np.int64)
    out[:1] = 0
    at = np.arange(1, len(order))
    one, two, limit = order[:-1], order[1:], len(words) - 1
    for off in range(0, depth, STEP):
        if not len(at):
            break
        differ = words[np.minimum(one + off, limit)] ^ words[np.minimum(two + off, limit)]
        gone = differ != 0
        if gone.any():
            first = (differ[gone].astype(">u8").view(np.uint8).reshape(-1, STEP) != 0).argmax(axis=1)
            out[at[gone]] = np.minimum(depth, off + first)
            stay = ~gone
            at, one, two = at[stay], one[stay], two[stay]
    return out


def repeated_starts(texts: list[bytes], windows: list[int], depth: int) -> list[np.ndarray]:
    """Per text: which of its first ``windows`` places start a string of ``depth`` bytes that occurs twice in ``texts``."""
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    wanted, starts = np.zeros(len(text), bool), np.zeros(len(text), bool)
    for b, n in zip(begin.tolist(), windows):
        wanted[b: b + n] = True
    starts[begin] = True
    words = _words(text)
    order = suffix_array(text, words, wanted, starts, depth)
    full = common_prefixes(words, order, depth) >= depth
    twice = full.copy()
    twice[:-1] |= full[1:]
    marks = np.zeros(len(text), bool)
    marks[order[twice]] = True
    return [marks[b: b + n] for b, n in zip(begin.tolist(), windows)]


def as_ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _method(window: int, gram: int) -> repeats.Method:
    def match(shards: list) -> list:
        flat = [run for shard in shards for run in shard]
        marks = iter(repeated_starts([u for _, u, _ in flat], [n for _, _, n in flat], window))
        return [[as_ranges(next(marks)) for _ in shard] for shard in shards]

    return repeats.Method(
        window=window, gram=gram, match=match, units=lambda: lambda text: np.frombuffer(text, np.uint8),
        cutter=lambda text: lambda start, end: text[start:end],
        repeat=lambda: F.col("times") > 1, whole=lambda: F.col("m") > 1)


def _keep(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, bytes]:
    if not len(start):
        return len(text), text
    cuts = zip([0, *end.tolist()], [*start.tolist(), len(text)])
    return len(text), b"".join(text[a:b] for a, b in cuts)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """One row per document: doc_id, n_units (bytes), spans (removed, merged), kept (bytes left).

    A byte goes if a string of ``window`` bytes that covers it also starts
    anywhere else, in the same document included. Texts are taken as UTF-8; a
    null text is empty and keeps nothing; texts shorter than the window stay
    whole; repeated rows remove each other; rows without doc_id take part; an
    empty table gives no rows; other columns are not read.
    """
    texts = keyed(docs)
    found = repeats.spans(texts, _method(window, min(gram, window)), hot)
    return repeats.removed(texts, found, _keep, repeats.result_schema(docs.schema["doc_id"].dataType))
