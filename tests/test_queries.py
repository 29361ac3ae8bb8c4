"""Each registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sigloom.plans import queries as Q


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        name = f.removesuffix(".parquet")
        path = f"{sf}/{f}"
        c.sql(f"create view {name} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(data, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf, con, name):
    got, want = Q.QUERIES[name](spark, sf), con.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.collect(), got.columns), rows(want.fetchall(), want.columns)
    assert a == b and a


def test_every_query_has_sql_or_a_reason():
    assert set(Q.QUERIES) - set(Q.SQL) == {"extraction"} and len(Q.SQL) > 65
