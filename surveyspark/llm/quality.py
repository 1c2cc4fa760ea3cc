"""Quality of documents by ordinal regression on graded ratings.

A cumulative-link model with proportional odds: all grades share one weight vector over
hashed features of the text, and P(grade > k) = sigmoid(w x - threshold_k) with
ascending thresholds. Grades come from ``labels``: 0 toxic, 1 poor, 2 good. From
the probabilities follow the expected grade and the tail P(grade = 2), by which
documents are selected.

Features are the different words (lower case, ASCII punctuation removed), the
punctuation that ends a word, the case of words, and shares of the text in steps
(different words, capitals, symbols, length of words). Each counts once per
document, so a few telling words are not drowned in a long text.

The model is fitted on the driver on a sample of at most ``sample`` labelled
documents (the smallest xxhash64 of their ids), whose hashed features are all that is
collected; everything else runs on all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.texts import text_or_empty
from surveyspark.llm.tiling import _PUNCTUATION

BITS = 18
SAMPLE = 10_000
GRADES = 3
# A document stays if P(grade = good) is at least this.
TAIL = 0.5
# Features seen in fewer sampled documents keep weight zero.
SEEN = 4
RIDGE = 1.0
STEPS = 300


class Features(dict):
    """Slots of the hashed features of a text; known words are kept, up to a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        slot = self[word] = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return slot

    def of(self, text: bytes) -> np.ndarray:
        raw = text.split()
        words = text.lower().translate(None, _PUNCTUATION).split()
        seen = set(words)
        n, size = max(len(raw), 1), max(len(text), 1)
        upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = size - len(text.translate(None, _PUNCTUATION))
        step = lambda name, share: b"\x00%s%d" % (name, min(10, int(10 * share)))
        extra = [step(b"distinct", len(seen) / max(len(words), 1)), step(b"upper", 4 * upper / size), step(b"symbols", 4 * symbols / size),
                 step(b"bare", len(words) / n), step(b"length", min(1.0, size / n / 20)), b"\x00empty" if not words else b"\x00text"]
        ends = {b"\x01" + w[-2:] for w in set(raw) if len(w) > 2 and w[-1] in _PUNCTUATION and w[-2] in _PUNCTUATION}
        return np.fromiter({self[w] for w in (*seen, *extra, *ends)}, np.int32)


@dataclass(frozen=True)
class Model:
    """Shared weights per feature slot and the ascending thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, one row per document."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def fit(slots: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood with a ridge, by gradient steps scaled per weight (Adam)."""
    seen = np.bincount(np.concatenate(slots) if slots else np.empty(0, np.int32), minlength=1 << BITS)
    used = seen >= SEEN
    names = np.full(1 << BITS, -1)
    names[used] = np.arange(used.sum())
    rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    cols = names[np.concatenate(slots)] if slots else np.empty(0, int)
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    n, m = len(slots), int(used.sum())
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    tail = 1 - np.cumsum(counts)[:-1] / counts.sum()
    theta = -np.log(tail / (1 - tail))
    # Thresholds stay in order: the first one, and logarithms of the gaps.
    params = np.concatenate((np.zeros(m), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
    if not n:
        return Model(np.zeros(1 << BITS), np.full(n_grades - 1, -60.0))
    first, second = np.zeros_like(params), np.zeros_like(params)
    up = grades[:, None] > np.arange(n_grades - 1)[None, :]
    for t in range(1, STEPS + 1):
        w, gaps = params[:m], np.exp(params[m + 1:])
        theta = params[m] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(rows, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -60, 60)))
        # P(grade) = P(> k-1) - P(> k); derivatives by the two neighbouring thresholds.
        edges = np.hstack((np.ones((n, 1)), p, np.zeros((n, 1))))
        slope = np.hstack((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))))
        i = np.arange(n)
        own = np.maximum(edges[i, grades] - edges[i, grades + 1], 1e-9)
        low, high = slope[i, grades] / own, slope[i, grades + 1] / own
        g_score = high - low
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, low, 0.0))
        np.add.at(g_theta, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -high, 0.0))
        grad = np.concatenate((np.bincount(cols, g_score[rows], m) + RIDGE * w, [g_theta.sum()],
                               gaps * np.cumsum(g_theta[::-1])[::-1][1:])) / n
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        params = params - 0.05 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = params[:m]
    theta = params[m] + np.concatenate(([0.0], np.cumsum(np.exp(params[m + 1:]))))
    return Model(weights, theta)


def _slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        found = [features.of(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        if found:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.record_batch([batch.column("grade"), lists], names=["grade", "slots"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled documents; rows with a null label or text are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").alias("_doc"), grade.cast("int").alias("grade")).filter("grade IS NOT NULL AND _doc IS NOT NULL")
    some = rated.orderBy(F.xxhash64(F.lit("rated"), "_doc"), "grade").limit(sample)
    pairs = docs.filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(some), F.col("doc_id") == F.col("_doc"))  # at most ``sample`` rows
    rows = pairs.select("text", "grade").mapInArrow(_slots, T.StructType([
        T.StructField("grade", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType()))])).toArrow()
    slots = rows.column("slots").combine_chunks()
    return fit([s.values.to_numpy() for s in slots], rows.column("grade").to_numpy().astype(int))


def _rate(model, columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), model.value
        for batch in batches:
            score = np.array([m.weights[features.of(t.as_buffer().to_pybytes())].sum() for t in batch.column("__quality_text")])
            above = m.above(score) if len(score) else np.empty((0, len(m.thresholds)))
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(above.sum(axis=1)), pa.array(above[:, -1])],
                                  names=[*columns, "__grade", "__tail"])
    return run


def rated(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus __grade (expected grade, 0 to 2) and __tail (P(best grade)). A null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the data
    schema = T.StructType([*docs.schema, T.StructField("__grade", T.DoubleType()), T.StructField("__tail", T.DoubleType())])
    return docs.withColumn("__quality_text", text_or_empty().cast("binary")).mapInArrow(_rate(shared, docs.columns), schema)


def judge(docs: DataFrame, labels: DataFrame, tail: float = TAIL, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, grade, p_good, kept.

    Without labels all documents get the best grade. Null and empty texts are
    rated by their lack of words; repeated rows and null ids are rated as they
    are; other columns are not read.
    """
    out = rated(docs.select("doc_id", "text"), train(docs, labels, sample))
    return out.select("doc_id", F.col("__grade").alias("grade"), F.col("__tail").alias("p_good"), (F.col("__tail") >= tail).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, tail: float = TAIL, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose P(best grade) is at least ``tail``, all columns."""
    return rated(docs, train(docs, labels, sample)).filter(F.col("__tail") >= tail).drop("__grade", "__tail")
