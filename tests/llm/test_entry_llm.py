"""The queries of the subpackage against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(cols, data):
    return sorted(repr(tuple(plain(r[c]) for c in sorted(cols))) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = queries.SQL.get(name)
    if sql:
        rel = con.sql(sql)
        want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(df.columns, want)
