"""The classifier: its forward pass by hand, folds, held-out accuracy and odd rows."""

import zlib

import numpy as np
import pytest

from sigloom.llm import queries, toxicity
from sigloom.llm.text import ALNUM, chunks


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def forward(model, ids):
    """One text, filter by filter and place by place."""
    x = [sum(model.emb[b].astype(float) for b in word) for word in ids]
    x += [np.zeros(toxicity.DIM)] * (1 + 2 * toxicity._PAD)
    pooled = []
    for ms in model.conv:
        places = range(len(ids) + 1 + toxicity._PAD)
        pooled += list(np.max([sum(x[p + j] @ m for j, m in enumerate(ms)) for p in places], 0))
    z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def tables(spark, sf):
    bigger = sf.replace("0.001", "0.1")
    return spark.read.parquet(f"{bigger}/documents.parquet"), spark.read.parquet(f"{bigger}/labels.parquet"), bigger


@pytest.fixture(scope="module")
def scored(spark, tables):
    return {r.doc_id: r for r in queries.op9_toxicity(spark, tables[2]).collect()}


def test_query(tables, scored):
    docs, labels, _ = tables
    assert len(scored) == docs.count()
    for i, r in scored.items():
        assert r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    of = [(scored[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in scored and held(r.doc_id)]
    hit = sum(p and t for p, t in of)
    assert sum(t for _, t in of) > 3
    print(f"held out: {len(of)} labels, recall {hit / sum(t for _, t in of):.3f}, precision {hit / sum(p for p, _ in of):.3f}")
    assert hit >= 0.8 * sum(t for _, t in of) and hit >= 0.9 * sum(p for p, _ in of)


def test_held_out_labels_do_not_matter(spark, tables, scored, tmp_path):
    docs, labels, sf = tables
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}).write.parquet(str(tmp_path / "documents.parquet"))
    again = {r.doc_id: r.score for r in queries.op9_toxicity(spark, str(tmp_path)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in scored.items())


def test_forward_pass_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" vile scum" if i % 3 == 0 else ""), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (1, 7), (2, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, labels)
    odd = [(None, "vile scum", None, 1), (1000, None, "en", 1), (1001, "", "en", 1), (1002, "... !", "zz", 1), (1003, "w1 " * 60_000 + "vile scum", "en", 1), (1004, "w1", "en", 1), (1004, "w1", "en", 1), (1005, "VILE scum", "en", 1)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.score) for r in toxicity.score(df, model).collect()]
    assert sorted(repr(i) for i, _ in got) == sorted(repr(r[0]) for r in odd)
    import pyarrow as pa

    for i, text, *_ in odd:
        (_, _, told), = chunks(pa.array([text], pa.string()), ALNUM)
        if len(told.hash) < 100:
            want = forward(model, toxicity.buckets(told))
            assert all(abs(s - want) < 1e-4 for j, s in got if j == i)
    by = dict(got)
    assert by[1000] == by[1001] == by[1002] < 0.3 and by[1003] > 0.5 and by[1005] > 0.5
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i in (1000, 1001, 1002, 1004, 1004))
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.without_toxic(df.limit(0), model).count() == 0


def test_without_labels_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "", None), (3, None, "en")], "doc_id long, text string, lang string")
    for rows in ([], [(1, 0), (2, 0)], [(9, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.without_toxic(docs, model).count() == 3
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
