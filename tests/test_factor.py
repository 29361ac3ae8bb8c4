"""The factorisation by blocks against the kernel, its starts, and the mixture of two normals."""

import numpy as np
import pytest

from sigloom.functions import kernels as K
from sigloom.operators import matrix as M
from sigloom.plans import extract as X
from sigloom.plans import factor as B


def _catalog(spark, v):
    cells = [(f"c{i:02}", f"s{j:02}", float(v[i, j])) for i in range(v.shape[0]) for j in range(v.shape[1]) if v[i, j]]
    return spark.createDataFrame(cells, "channel string, sample string, cnt double"), [f"c{i:02}" for i in range(v.shape[0])]


def _dense(acts, k, r, n):
    h = np.zeros((k, n))
    for row in acts.where(f"k = {k} and replicate = {r}").collect():
        h[row.component, int(row.sample[1:])] = row.activity
    return h


def test_blocks_equal_the_kernel(spark, monkeypatch):
    """Any split into blocks gives the kernel's factors, iterations and losses, also where blocks are written in between."""
    rng = np.random.default_rng(4)
    v = rng.poisson(rng.random((12, 3)) @ rng.random((3, 23)) * 50).astype(float)
    cat, channels = _catalog(spark, v)
    starts = {(k, r): (rng.random((12, k)), rng.random((k, 23))) for k in (1, 2, 3) for r in (0, 1)}
    monkeypatch.setattr(B, "WRITE_EVERY", 7)
    held = B.blocks(cat, channels, [1, 2, 3], [0, 1], lambda x, *_: (x.sum(), x), lambda k, r, s: starts[k, r][1][:, int(s[1:])], np.float64, block=5)
    f = B.factor(held, {key: w for key, (w, _) in starts.items()}, [1, 2, 3], channels, np.float64, 10, 40, 10, 1e-4)
    acts = B.activities(f, scale=False)
    for (k, r), (w, h) in starts.items():
        monkeypatch.setattr(K, "start", lambda *_, w=w, h=h: (w, h))
        a, b, n = K.nmf(v, k, rng, "random", 1.0, "double", 10, 40, 10, 1e-4)
        assert f.iterations[k, r] == n and np.allclose(f.weights[k, r], a, rtol=1e-6) and np.allclose(_dense(acts, k, r, 23), b, rtol=1e-6)
        assert f.losses[k, r] == pytest.approx(K.kl_loss(v, a, b), rel=1e-6)
    assert f.iterations[1, 0] == 20 and len(set(f.iterations.values())) > 1
    m = {(r.k, r.replicate): r.metrics for r in B.metrics(f).collect()}
    assert np.allclose(m[2, 1], K.similarities(v, f.weights[2, 1] @ _dense(acts, 2, 1, 23)))


@pytest.mark.parametrize("how", ["nndsvd", "nndsvda", "nndsvdar", "nndsvd_min"])
def test_singular_starts_equal_the_kernel(spark, how):
    rng = np.random.default_rng(5)
    v = rng.poisson(rng.random((10, 4)) @ rng.random((4, 17)) * 80).astype(float) + 1
    cat, channels = _catalog(spark, v)
    held = B.blocks(cat, channels, [2, 4], [0], lambda x, *_: (x.sum(), x), lambda k, *_: np.zeros(k), np.float64, block=6)
    new, weights = B.singular_starts(held, [2, 4], channels, np.float64, how, 3)
    for k in (2, 4):
        w, h = K.nndsvd(v, k, {"nndsvd": "", "nndsvda": "a", "nndsvdar": "ar", "nndsvd_min": "min"}[how], np.random.default_rng(1))
        f = B.Factors([2, 4], channels, np.float64, weights, dict.fromkeys(weights, 0), {}, new)
        got_h = _dense(B.activities(f, scale=False), k, 0, 17)
        loose = 0.011 * v.mean() if how in ("nndsvdar", "nndsvd_min") else 1e-8  # the random small values differ
        assert np.allclose(weights[k, 0], w, atol=loose) and np.allclose(got_h, h, atol=loose)
    with pytest.raises(ValueError):
        B.singular_starts(held, [2], channels, np.float64, "zeros", 3)


@pytest.mark.parametrize("init", ["random", "nndsvdar"])
def test_extraction_by_blocks_recovers_planted(spark, init):
    rng = np.random.default_rng(5)
    w = np.repeat(np.eye(3), 8, 0) * rng.random((24, 3)) + 0.002
    w /= w.sum(0)
    v = rng.poisson(w @ (rng.random((3, 20)) ** 2 * 3000)).astype(float)
    cat, _ = _catalog(spark, v)
    p = X.Parameters(minimum_signatures=2, maximum_signatures=3, nmf_replicates=3, nmf_init=init, min_nmf_iterations=20, max_nmf_iterations=60, nmf_test_conv=20, nmf_tolerance=1e-5, clustering_restarts=3, seed=3, most_cells=100)
    e = X.extract(cat, p)
    true = spark.createDataFrame([(f"c{i:02}", f"t{k}", float(w[i, k])) for i in range(24) for k in range(3)], "channel string, signature string, weight double")
    assert e.chosen == 3 and X.match_signatures(true, e.signatures.where("k = 3"))["f1"] == 1.0
    totals = {(r.k, r.replicate): r.n for r in e.replicate_activities.groupBy("k", "replicate").agg({"activity": "sum"}).withColumnRenamed("sum(activity)", "n").collect()}
    assert len(totals) == 6 and all(abs(n / v.sum() - 1) < 0.01 for n in totals.values())
    assert e.convergence.count() == 6 and e.activity_errors.where("sem is not null").count() == 20 * 5
    e.release()


def test_mixture(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(1000, 50, 300), rng.normal(90_000, 3000, 40)]).round()
    df = spark.createDataFrame([(f"s{i}", float(t)) for i, t in enumerate(x)], "sample string, total double")
    normals = M.two_normals(df.selectExpr("total as x", "1 as n"))
    assert normals[0][0] == pytest.approx(x[:300].mean(), rel=1e-3) and normals[1][0] == pytest.approx(x[300:].mean(), rel=1e-3) and normals[1][2] == pytest.approx(40 / 340, rel=1e-3)
    assert M.mixture_cutoff(df, 100) == pytest.approx(x[:300].mean() + 2 * x[:300].std(), rel=0.02)
    even = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "sample string, total double")
    assert M.mixture_cutoff(even, 3) == 5 and M.mixture_cutoff(even, 96) == 96 and M.mixture_cutoff(even.limit(0), 96) == 96


def test_singular_values(spark):
    rng = np.random.default_rng(7)
    v = rng.poisson(5, (6, 15)).astype(float)
    cat, channels = _catalog(spark, v)
    u, values = M.singular(cat, 6)
    s = np.linalg.svd(v, compute_uv=False)
    got = values.orderBy("component").collect()
    assert np.allclose([r.value for r in got], s) and got[1].error == pytest.approx(np.sqrt((s[2:] ** 2).sum() / (s**2).sum()))
    y = M.right_vectors(cat, u, values)
    back = {(r.channel, r.sample): r.z for r in u.join(y, "component").join(values, "component").selectExpr("channel", "sample", "x * y * value as z").groupBy("channel", "sample").sum("z").withColumnRenamed("sum(z)", "z").collect()}
    assert all(abs(back[c, f"s{j:02}"] - v[i, j]) < 1e-6 for i, c in enumerate(channels) for j in range(15))
