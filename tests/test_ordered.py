"""Order statistics, rank tests and spanning trees against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import kernels as K
from sigloom.operators import matrix as M
from sigloom.operators import ordered as O


def test_medians(spark):
    rng = random.Random(1)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 9 + [1.0], "wide": [10.0**e for e in range(-300, 300, 7)] + [-1e300, 0.0], "many": [rng.gauss(0, 1) for _ in range(2001)], None: [2.0, 4.0, 9.0]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("two", None), ("none", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.median for r in O.medians(df, ("g",)).collect()}
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in groups.items()}
    assert O.medians(df.limit(0), ("g",)).count() == 0
    third = O.order_statistics(df.where("g = 'many'"), ("g",), {"first": F.lit(0), "third": F.lit(2), "last": F.col("n") - 1}).first()
    many = sorted(groups["many"])
    assert (third.first, third.third, third.last) == (many[0], many[2], many[-1])


def test_rank_tests(spark):
    rng = np.random.default_rng(2)
    errors = {k: rng.normal(50 - k, 4, 60 + k).round(0) for k in range(4)}
    df = spark.createDataFrame([(k, float(x)) for k, v in errors.items() for x in v], "k int, x double")
    import math

    for r in O.rank_tests(df, 3).collect():
        assert math.erfc(abs(r.z) / math.sqrt(2)) == pytest.approx(K.rank_sum_p(errors[3], errors[r.k])) and r.median == np.median(errors[r.k])


def test_spanning_tree(spark):
    rng = random.Random(3)
    pairs = [(a, b, float(rng.randrange(20))) for a in range(60) for b in rng.sample(range(60), 4)] + [(100, 101, 1.0), (101, 102, 1.0), (100, 102, 1.0), (7, 7, 0.0), (None, 3, 0.0)]
    df = spark.createDataFrame(pairs, "a long, b long, distance double")
    tree, comps = O.spanning_tree(df)
    root = {i: i for p in pairs for i in p[:2] if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0.0
    for a, b, d in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[2]):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            total += d
    edges = tree.collect()
    label = {r.id: r.comp for r in comps.collect()}
    assert sum(e.distance for e in edges) == total and len(edges) == len(label) - len(set(label.values()))
    for x in label:
        assert label[x] == min(y for y in label if find(y) == find(x))
    chain = spark.range(400).selectExpr("id as a", "id + 1 as b", "1.0D as distance")
    assert {r.cluster for r in M.single_linkage(chain, spark.range(402), 1.0).collect()} == {0, 401}
    empty, none = O.spanning_tree(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_silhouettes_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, rng.normal(i % 5, 1, 6).tolist()) for i in range(80)] + [(80, 9, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, cluster int, vector array<double>")
    whole = {r.id: r.silhouette for r in M.silhouettes(df).collect()}
    x = np.array([r[2] for r in rows])
    want = K.silhouette(K.distances(x.T, x.T), np.array([r[1] for r in rows]))
    assert all(whole[i] == pytest.approx(want[i]) for i in range(81))
    monkeypatch.setattr(M, "MOST_SUMS", 13)
    assert {r.id: pytest.approx(r.silhouette) for r in M.silhouettes(df).collect()} == whole
