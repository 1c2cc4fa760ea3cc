"""Registered queries against their SQL twins on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from surveyspark.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROWS_ONLY = {"full_report"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return repr(float(v) + 0.0) if isinstance(v, (float, decimal.Decimal)) else repr(v)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(norm(v) for v in (dict(zip(names, r))[c] for c in df.columns)) for r in cursor.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want
