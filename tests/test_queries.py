"""Every registered query with SQL against DuckDB on the smallest tables; the others must run and give rows."""

import os

import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from vectide.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    assert got
    if name in ORACLE_SQL:
        rel = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, rel.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns and df.count() >= 0


def test_registered():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
