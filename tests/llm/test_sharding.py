import zlib

import pytest

from sigloom.llm.sharding import shard


def check(rows, got, n, spread):
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    load = [0] * n
    for r in got:
        assert any(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in texts[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        load[r.shard] += r.size
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(load) - min(load) <= spread


@pytest.mark.parametrize("n", [1, 3, 8])
def test_cases(spark, n):
    rows = [(i, None if i % 11 == 0 else "" if i % 13 == 0 else f"text {i % 50} " * (i % 7)) for i in range(400)]
    rows += [(1000 + i, "one hot text of many copies") for i in range(200)] + [(-5, "é" * 100), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' shard", "1 k1", "2 at")
    check(rows, shard(df, n).collect(), n, 200)
    check(rows, shard(df, n, carry=["doc_id"]).collect(), n, 200)


def test_other_law_and_empty(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(83)], "doc_id long, text string")
    sizes = [r["count"] for r in shard(df, 8, law="rows").groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert shard(df.limit(0)).count() == 0
    assert {r.shard for r in shard(df.limit(2)).collect()} <= set(range(8))
    with pytest.raises(ValueError):
        shard(df, law="keys")


def test_equal_texts_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i // 2} " * 20) for i in range(20000)], "doc_id long, text string")
    got = shard(df, 8, tolerance=0.01)
    assert got.count() == 20000 and got.groupBy(got.text).agg({"shard": "min"}).count() == 10000
    assert got.groupBy("text").agg({"shard": "min", "size": "count"}).join(got, "text").where("`min(shard)` <> shard").count() == 0


def test_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in d.collect()], shard(d, 8).collect(), 8, 40000)
