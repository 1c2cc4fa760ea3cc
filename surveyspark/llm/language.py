"""Languages of documents as mixtures of n-gram models.

Learned: per language the counts of letter trigrams of all training documents,
hashed to ``1 << BITS`` slots, smoothed. Nothing else is learned, so what tasks
receive is languages x slots numbers, whatever the size of the corpus.

Inference: a document is a mixture of languages. Expectation-maximisation
estimates the proportions from the trigrams' likelihoods. The set of languages is
grown from the single most likely one: the language that improves the mixture most joins
while the gain in log-likelihood is above a penalty per language that grows with the
logarithm of the document's length. The prediction is the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.texts import mixed

BITS = 16
SMOOTH = 0.5
# Languages beyond this are not expected; more are an error, not cut.
MOST_LANGUAGES = 500
# Overlapping trigrams say the same thing about three times.
PENALTY = 3.0
STEPS = 25
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str) -> np.ndarray:
    """Slots of the trigrams around each letter; other characters are one boundary. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 0)
    # Runs of other characters count once.
    stay = letter | np.concatenate(([True], letter[:-1]))
    points = np.concatenate(([0], points[stay], [0])).astype(np.uint64)
    middle = np.flatnonzero(points[1:-1]) + 1
    packed = points[middle - 1] << np.uint64(42) | points[middle] << np.uint64(21) | points[middle + 1]
    return (mixed(packed) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            own = seen.get(lang)
            if own is None:
                own = seen[lang] = np.zeros(1 << BITS, np.int64)
            own += np.bincount(trigrams(text.as_py()), minlength=1 << BITS)
    for lang, own in seen.items():
        used = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])],
                              names=["lang", "slot", "n"])


class Model:
    """Smoothed probabilities of the slots, one column per language, languages in order of their names."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + SMOOTH
        self.p = (smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float64) if langs else counts
        self.log_p = np.log(self.p) if langs else counts

    def mixture(self, slots: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Chosen languages and their proportions."""
        used, n = np.unique(slots, return_counts=True)
        p, n = self.p[used], n.astype(np.float64)
        single = n @ self.log_p[used]
        chosen, share = [int(np.argmax(single))], np.ones(1)
        best, penalty = single[chosen[0]], PENALTY * np.log(max(len(slots), 2))
        while len(chosen) < len(self.langs):
            # A language can only help if its likelihood ratio to the mixture is above one on average.
            helps = n @ (p / (p[:, chosen] @ share)[:, None]) / n.sum()
            others = [k for k in np.argsort(-helps, kind="stable").tolist() if helps[k] > 1 and k not in chosen]
            if not others:
                break
            tried = [*chosen, others[0]]
            fit, total = self._em(p[:, tried], n, np.append(share * 0.9, 0.1))
            if total - best <= penalty:
                break
            chosen, share, best = tried, fit, total
        return chosen, share

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(STEPS):
            joint = p * share
            share = n @ (joint / joint.sum(axis=1, keepdims=True)) / n.sum()
        return share, float(n @ np.log(p @ share))


def train(docs: DataFrame) -> Model:
    """Counts over all rows of ``docs`` (text, lang); null texts and languages are left out."""
    counts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        _count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs.sort()
    rows = counts.toArrow()  # languages x slots at most
    table = np.zeros((1 << BITS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    cols = np.fromiter((at[k] for k in rows.column("lang").to_pylist()), np.int64, rows.num_rows)
    table[rows.column("slot").to_numpy(), cols] = rows.column("n").to_numpy()
    return Model(langs, table)


def _predict(model, columns: list[str]):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = []
            for text in batch.column("__language_text"):
                slots = trigrams(text.as_py())
                if not len(slots) or not m.langs:
                    out.append([])
                    continue
                chosen, share = m.mixture(slots)
                order = np.argsort(-share, kind="stable")
                out.append([{"lang": m.langs[chosen[k]], "share": float(min(1.0, share[k]))} for k in order])
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(out, kind)], names=[*columns, "__languages"])
    return run


def mixtures(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus __languages: array of (lang, share), largest share first; empty if the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x slots
    kind = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    return docs.withColumn("__language_text", F.coalesce("text", F.lit(""))).mapInArrow(
        _predict(shared, docs.columns), T.StructType([*docs.schema, T.StructField("__languages", kind)]))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages.

    Learns from documents whose crc32(doc_id as text) modulo 5 is not 0 and that
    have a language; the others, and those without doc_id, are held out or left
    out of learning. Predictions read the text only. A text without letters, a
    null text or a model without languages gives ``und`` with score 0. Repeated rows
    count as often as they occur; an empty table gives no rows.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held = F.coalesce(part == 0, F.lit(False))
    model = train(docs.filter(part != 0))
    got = mixtures(docs.select("doc_id", held.alias("held_out"), "text"), model)
    top = F.get("__languages", F.lit(0))
    return got.select("doc_id", "held_out", F.coalesce(top["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
                      F.coalesce(top["share"], F.lit(0.0)).alias("score"), F.col("__languages").alias("languages"))
