"""The auction against the exact matching."""

import numpy as np
import pytest

from sigloom.functions import kernels as K
from sigloom.operators.matching import assign
from sigloom.plans import extract as X


@pytest.mark.parametrize(("n", "m"), [(1, 1), (6, 6), (4, 9), (9, 4)])
def test_auction_is_within_its_tolerance(spark, n, m):
    rng = np.random.default_rng(n * 10 + m)
    cost = rng.random((n, m)).round(2)
    df = spark.createDataFrame([(i, j, float(cost[i, j])) for i in range(n) for j in range(m)] + [(0, 0, 9.0), (None, 0, 0.0)], "a long, b long, cost double")
    got = assign(df, tolerance=0.001).collect()
    at = K.match(cost)
    best = sum(cost[i, j] for i, j in enumerate(at) if j >= 0)
    k = min(n, m)
    assert len(got) == len({r.a for r in got}) == len({r.b for r in got}) == k
    assert best - 1e-9 <= sum(r.cost for r in got) <= best + 0.001 * k + 1e-9 and all(r.cost == cost[r.a, r.b] for r in got)


def test_impossible_pairs_and_leaving(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("y", "p", 2.0), ("z", "q", 5.0)], "a string, b string, cost double")
    assert sorted(map(tuple, assign(df).collect())) == [("x", "p", 1.0), ("z", "q", 5.0)]
    assert sorted(map(tuple, assign(df, leave=3.0).collect())) == [("x", "p", 1.0)]
    assert assign(df.limit(0)).count() == 0


def test_many_signatures_are_matched_by_bids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    w = rng.random((12, 5)) ** 4
    rows = lambda x: [(f"c{i}", f"s{j}", float(x[i, j])) for i in range(12) for j in range(5)]
    kind = "channel string, signature string, weight double"
    true, found = spark.createDataFrame(rows(w), kind), spark.createDataFrame(rows(w[:, ::-1] + 0.001), kind)
    few = X.match_signatures(true, found)
    monkeypatch.setattr(X, "MOST_PAIRS", 3)
    assert X.match_signatures(true, found) == few and few["tp"] == 5
