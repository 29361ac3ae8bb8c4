"""Each query that SQL can express against its SQL."""

import os
import time

import duckdb
import pytest

from sigloom.llm.oracle import ORACLE
from sigloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{sf}/{f}'")
    got, began = QUERIES[name](spark, sf), time.time()
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    b = norm(want.fetchall())
    print(name, "SQL", round(time.time() - began, 1), "s")
    assert norm(got.select(*want.columns).collect()) == b and b
