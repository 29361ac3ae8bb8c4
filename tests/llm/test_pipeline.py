"""Each stage against what it must keep, over the smallest tables."""

import corpus_pipeline
from test_decontaminate import brute
from test_minhash_dedup import brute as brute_groups


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs.collect()
        assert set(columns) <= set(docs.columns)
    groups = brute_groups(seen["near_duplicates"][0], 5)
    assert sorted(r.doc_id for r in seen["near_duplicates"][1]) == sorted(i for i, g in groups.items() if g[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = seen["decontamination"]
    marked = brute(before, items)
    left = {r.doc_id: r.text for r in after}
    assert all(left.get(i) == t for i, t in before if not marked[i][4])
    assert not any(v[4] for v in brute(list(left.items()), items).values())
    assert 0 < len(seen["mixing"][1]) <= len(seen["mixing"][0])
    assert sorted(r.doc_id for r in seen["sharding"][1]) == sorted(r.doc_id for r in seen["mixing"][1])
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in seen["toxicity"][1]}
    assert len(kept & toxic) <= 0.2 * len(toxic) and len(kept & clean) >= 0.95 * len(clean)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_repeated_rows_and_null_ids(spark, sf):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(20)) for p in "abcd")
    rows = [(7, a), (7, a), (7, a), (9, a), (5, b), (5, c), (6, c), (None, d), (None, d), (None, b), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(7, a), (5, b), (5, c), (None, d), (8, ""), (8, "")], key=repr)
