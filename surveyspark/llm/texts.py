"""What the text operators share: words, hashes, row keys and scratch tables."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.session import scratch_path

# A word, for Java and DuckDB. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# Spark's setting to delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text that tells rows of one doc_id apart, and the text's bytes."""
    return docs.select(F.col("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().cast("binary").alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, which cuts its lineage.

    The shuffle files behind it go once it is written: nothing reads them again, and the driver's
    garbage collector, which would free them otherwise, may not run for a long time.
    """
    spark = df.sparkSession
    path, was = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * _MIX
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class WordHash(dict):
    """64-bit hash of each word; frequent words are hashed once per task.

    Emptied when it holds a million words, so that its memory is bounded.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes of all stretches of a sequence, modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 1 << 16)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, items: np.ndarray) -> np.ndarray:
        self._reach(len(items) + 1)
        out = np.zeros(len(items) + 1, np.uint64)
        np.cumsum((items.astype(np.uint64) + np.uint64(1)) * self.powers[: len(items)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._reach(len(prefix))
        return mixed((prefix[end] - prefix[start]) * self.inverses[start])
