"""Repeated word sequences by suffix automata of reference shards.

The corpus is cut into reference shards by the anchors of its windows (see
``repeats``): a window can only repeat inside the shard of its anchor. Each
shard gets a suffix automaton of its word sequences, and the documents that
touch the shard are streamed through it in the order of their ids: matching
statistics give, per word, the longest suffix that the shard holds, and the
state of that suffix knows the first document it came from. What a document adds
is then inserted, so the automaton holds each sequence once. Shards are
bounded (``repeats.HOT``) where a broadcast of whole document shards would have
to visit every document for every shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import repeats
from surveyspark.llm.suffix_array import as_ranges
from surveyspark.llm.texts import WordHash, keyed

WINDOW = 50
GRAM = 8


class SuffixAutomaton:
    """Automaton of several sequences; each state keeps the first document that reached it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def insert(self, items: list, doc: int) -> None:
        """Adds a sequence. Documents come in ascending order, so a state's first one is its earliest."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for x in items:
            q = nxt[last].get(x)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, x, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(doc)
            link.append(0)
            p = last
            while p >= 0 and x not in nxt[p]:
                nxt[p][x] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][x]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, x, q)
            last = cur

    def _split(self, p: int, x, q: int) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        first.append(first[q])
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = clone
            p = link[p]
        return clone

    def stream(self, items: list, window: int) -> list[int]:
        """Per window of ``items``: the first document that holds it, -1 if none does."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, v, n = [], 0, 0
        for i, x in enumerate(items):
            while v and x not in nxt[v]:
                v = link[v]
                n = length[v]
            if x in nxt[v]:
                v, n = nxt[v][x], n + 1
                while length[link[v]] >= window:
                    v = link[v]
                    n = length[v]
            else:
                n = 0
            if i >= window - 1:
                out.append(first[v] if n >= window else -1)
        return out


def earlier(shard: list[tuple[int, bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """Ranges of the windows of each run that an earlier document of the shard holds."""
    auto, out = SuffixAutomaton(), []
    for doc, units, n in shard:
        words = units.split()
        seen = auto.stream(words, window)
        out.append(as_ranges(np.array([0 <= s < doc for s in seen])))
        new = [i for i, s in enumerate(seen) if s < 0]
        if new:
            auto.insert(words[new[0]: new[-1] + window], doc)
    return out


def _units():
    known = WordHash()
    return lambda text: known.all(text.to_pybytes().split())


def _cutter(text: bytes):
    words = text.split()
    return lambda start, end: b" ".join(words[start:end])


def _before(own: str, other: str):
    return F.col(other).isNotNull() & (F.col(own).isNull() | (F.col(other) < F.col(own)))


def _method(window: int, gram: int) -> repeats.Method:
    return repeats.Method(
        window=window, gram=gram, match=lambda shards: [earlier(s, window) for s in shards], units=_units, cutter=_cutter,
        repeat=lambda: _before("doc_id", "earliest.doc_id"), whole=lambda: _before("doc_id", "first.doc_id"))


def _keep(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, bytes]:
    words = text.split()
    if len(start):
        cuts = zip([0, *end.tolist()], [*start.tolist(), len(words)])
        return len(words), b" ".join(w for a, b in cuts for w in words[a:b])
    return len(words), b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """One row per document: doc_id, n_units (words), spans (of removed words, merged), kept (words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id. Rows without doc_id come after all others
    and never remove one another; rows that share a doc_id don't either. A null
    text has no words; an empty table gives no rows; other columns are not read.
    """
    texts = keyed(docs)
    found = repeats.spans(texts, _method(window, min(gram, window)), hot)
    return repeats.removed(texts, found, _keep, repeats.result_schema(docs.schema["doc_id"].dataType))
