"""Resamples by splitting down a tree of channels."""

import numpy as np
import pytest

from sigloom.operators import resample as R


def cells(spark, rows):
    return spark.createDataFrame(rows, "channel string, sample string, cnt double")


def test_totals_stay_and_moments_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", s, float(n)) for s, top in (("a", 40), ("b", 4000)) for i, n in enumerate(rng.integers(0, top, 96))]
    n = 200
    got = R.resample(cells(spark, rows), n, seed=5).toPandas()
    want = {s: sum(c for _, t, c in rows if t == s) for s in "ab"}
    totals = got.groupby(["sample", "replicate"])["cnt"].sum()
    assert len(totals) == 2 * n and all(totals[s, r] == want[s] for s in "ab" for r in range(n))
    for s in "ab":
        x = got[got["sample"] == s].pivot(index="replicate", columns="channel", values="cnt").fillna(0)
        p = {c: k / want[s] for c, t, k in rows if t == s and k}
        assert set(x.columns) <= set(p)
        z = [(x[c].mean() - want[s] * p[c]) / np.sqrt(want[s] * p[c] * (1 - p[c]) / n) for c in x]
        assert max(map(abs, z)) < 4.5 and 0.7 < np.var(z) < 1.4
        ratio = np.array([x[c].var() / (want[s] * p[c] * (1 - p[c])) for c in x if want[s] * p[c] > 5])
        assert 0.9 < ratio.mean() < 1.1
        # cells of one sample lean against each other: covariance is -n p q
        a, b = sorted(p, key=p.get)[-2:]
        expected = -want[s] * p[a] * p[b]
        sd = want[s] * np.sqrt(p[a] * p[b] / n)
        assert abs(np.cov(x[a], x[b])[0, 1] - expected) < 5 * sd


def test_draws_do_not_depend_on_layout(spark):
    rows = [(f"c{i}", f"s{i % 3}", float(1 + i % 7)) for i in range(300)]
    one = R.resample(cells(spark, rows).coalesce(1), 3, seed=1)
    two = R.resample(cells(spark, rows[::-1]).repartition(7), 3, seed=1)
    key = lambda df: sorted(map(tuple, df.collect()))
    first = key(one)
    assert first == key(two)
    assert first != key(R.resample(cells(spark, rows), 3, seed=2))


def test_shared_buckets_split_what_reaches_them(spark, monkeypatch):
    monkeypatch.setattr(R, "SPARE", -5)
    rows = [(f"c{i}", "s", 50.0) for i in range(40)]
    got = R.resample(cells(spark, rows), 20).toPandas()
    assert set(got.groupby("replicate")["cnt"].sum()) == {2000} and got["channel"].nunique() == 40
    assert abs(got.groupby("channel")["cnt"].mean() - 50).max() < 10


def test_cases(spark):
    rows = [("x", "one", 7.0), ("x", "none", 0.0), ("y", "none", None), ("y", "sum", 2.0), ("y", "sum", 3.0), ("z", "sum", -4.0), (None, None, 3.0), ("x", None, 0.4)]
    df = cells(spark, rows).selectExpr("*", "1 as bucket", "2 as weight", "3 as path")
    got = {tuple(r) for r in R.resample(df, 2).collect()}
    assert got == {("x", "one", 0, 7), ("x", "one", 1, 7), ("y", "sum", 0, 5), ("y", "sum", 1, 5), (None, None, 0, 3), (None, None, 1, 3)}
    assert R.resample(df.limit(0), 2).count() == 0 and R.resample(df, 0).count() == 0
    spread = {(r.channel, r.sample): (r.cnt, r.mean, r.sd) for r in R.resampling_spread(df, 4).collect()}
    assert spread == {("x", "one"): (7, 7.0, 0.0), ("y", "sum"): (5, 5.0, 0.0), (None, None): (3, 3.0, 0.0)}
    with pytest.raises(ValueError):
        R.resampling_spread(df, 1)
