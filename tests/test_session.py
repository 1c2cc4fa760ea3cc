import pytest
from pyspark.sql import functions as F

from surveyspark import session
from surveyspark.session import materialize, shared_dir

from conftest import rows


def test_salted_join_equals_broadcast(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"))
    small = materialize(spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    assert small.rows == 10
    for how in ("inner", "left"):
        a = small.join_into(big, ["k"], how)
        b = small.join_into(big, ["k"], how, spread="id", limit=0)
        c = small.join_into(big, ["k"], how, limit=0)
        assert rows(a.fillna(-1)) == rows(b.fillna(-1)) == rows(c.fillna(-1))


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
