"""Session helpers: builder, shared scratch folder, materialised tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows, and measured bytes, of a materialised table up to which it is sent to
# every executor; above either the salted shuffle join takes over.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 128 << 20
# Copies of each small-side row in the salted join: one hot key is spread over
# this many tasks.
SALTS = 64


def local_session(cores: int | str = "*", app: str = "surveyspark") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only made up in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Materialized:
    """A table written once to the shared folder, with its row count and the bytes of its values."""

    df: DataFrame
    rows: int
    bytes: int = 0

    def narrow(self, *columns) -> Materialized:
        """The same rows with fewer, renamed or derived columns."""
        return Materialized(self.df.select(*columns), self.rows, self.bytes)

    def join_into(self, big: DataFrame, keys: list[str], how: str = "inner",
                  spread: str | None = None, limit: int | None = None) -> DataFrame:
        """Join this table into ``big`` on ``keys``.

        Broadcast while rows and bytes, counted when it was written, allow it. Beyond that, ``big`` is
        salted by the ``spread`` column and this side is copied once per salt,
        so a key that holds a third of ``big`` is split over many tasks.
        """
        if self.rows <= (BROADCAST_ROWS if limit is None else limit) and self.bytes <= BROADCAST_BYTES:
            return big.join(F.broadcast(self.df), keys, how)
        if spread is None:
            return big.join(self.df, keys, how)
        salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        copies = self.df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def _width(kind: T.DataType) -> int:
    """Bytes of a value of fixed width; 16 stand for what varies inside an array."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind)
    return 16 if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) else 8


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a column's values: texts by length, arrays by their number of entries."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.StructType)):  # arrays inside are summed up
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda n, v: n + _bytes(v, kind.elementType)), F.lit(0))
        size = F.size(value) * _width(kind.elementType)
    elif isinstance(kind, T.MapType):
        size = F.size(value) * (_width(kind.keyType) + _width(kind.valueType))
    elif isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    else:
        return F.lit(8).cast("bigint")
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint") + 8


def materialize(df: DataFrame) -> Materialized:
    """Write ``df`` to the shared folder, and count its rows and bytes in the same pass.

    Columns are written apart and compressed, which takes a fraction of the bytes of a checkpoint of
    rows, and what reads the table later reads the columns it needs.
    """
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("bigint"))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    path = scratch_path(df.sparkSession, "table")
    counted.write.parquet(path)
    return Materialized(df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["bytes"])
