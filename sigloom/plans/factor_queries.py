"""Registered queries of the factorisation by blocks, its cutoff and its starts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import matrix as M
from ..operators import ordered as O
from ..operators.matching import assign
from ..operators.resample import resample
from ..sources.shared import written
from . import factor as B
from .queries import CATALOG_SQL, WH_SQL, catalog, query, six, table

ROUNDS, TOLERANCE = 5, 1e-9


def _keyed_sql() -> str:
    """Two keys, ranks 1 and 2, five rounds each; a key's rows are those of the round at which its loss has converged."""
    parts = ["w1_0 AS (SELECT * FROM w WHERE signature = 'A')", "h1_0 AS (SELECT * FROM h WHERE signature = 'A')", "w2_0 AS (SELECT * FROM w)", "h2_0 AS (SELECT * FROM h)"]
    estimate = lambda name, w, h: f"{name} AS (SELECT channel, sample, sum(weight * activity) AS est FROM {w} JOIN {h} USING (signature) GROUP BY 1, 2)"
    loss = lambda k, i: f"l{k}_{i} AS (SELECT {k} AS k, {i} AS i, sum(coalesce(cnt * ln(cnt / est) - cnt, 0) + est) AS loss FROM e{k}_{i} LEFT JOIN catalog USING (channel, sample))"
    for k in (1, 2):
        parts += [estimate(f"e{k}_0", f"w{k}_0", f"h{k}_0"), loss(k, 0)]
        for i in range(1, ROUNDS + 1):
            w, h, e = f"w{k}_{i - 1}", f"h{k}_{i - 1}", f"e{k}_{i - 1}"
            parts.append(f"w{k}_{i} AS (SELECT w.channel, w.signature, any_value(weight) * sum(coalesce(cnt, 0) / est * activity) / sum(activity) AS weight FROM {w} w JOIN {h} h USING (signature) JOIN {e} e ON e.channel = w.channel AND e.sample = h.sample LEFT JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)")
            parts.append(estimate(f"f{k}_{i}", f"w{k}_{i}", h))
            parts.append(f"h{k}_{i} AS (SELECT h.sample, h.signature, any_value(activity) * sum(coalesce(cnt, 0) / est * weight) / sum(weight) AS activity FROM w{k}_{i} w JOIN {h} h USING (signature) JOIN f{k}_{i} e ON e.channel = w.channel AND e.sample = h.sample LEFT JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)")
            parts += [estimate(f"e{k}_{i}", f"w{k}_{i}", f"h{k}_{i}"), loss(k, i)]
    every = lambda name, cols: " UNION ALL ".join(f"SELECT {k} AS k, {i} AS i, {cols} FROM {name}{k}_{i}" for k in (1, 2) for i in range(ROUNDS + 1))
    tail = f"""losses AS ({' UNION ALL '.join(f'SELECT * FROM l{k}_{i}' for k in (1, 2) for i in range(ROUNDS + 1))}),
fall AS (SELECT k, i, (lag(loss) OVER (PARTITION BY k ORDER BY i) - loss) / first_value(loss) OVER (PARTITION BY k ORDER BY i) AS fall FROM losses),
stop AS (SELECT k, coalesce(min(i) FILTER (WHERE i > 1 AND fall < {TOLERANCE}), 0) AS iterations FROM fall GROUP BY 1), acts AS
 ({every('h', 'sample, signature, activity')})
SELECT k::INTEGER AS k, iterations::INTEGER AS iterations, sample, signature, round(activity, 6) AS activity FROM acts JOIN stop USING (k) WHERE i = CASE
 iterations WHEN 0 THEN {ROUNDS} ELSE iterations END"""
    return f"WITH {CATALOG_SQL}, {WH_SQL}, {', '.join(parts)}, {tail}"


@query(_keyed_sql())
def nmf_keyed(spark, d):
    """Ranks 1 and 2 from the formula's factors in the same rounds over blocks: rank 1 has converged after the second and leaves."""
    cat = catalog(spark, d)
    channels = sorted(r[0] for r in cat.select("channel").distinct().collect())
    of_channel = lambda c: [1 + len(c) % 3 + ord(c[0]) % 5, 1 + ord(c[0]) % 3]
    of_sample = lambda k, _, s: np.array([10.0 + len(s), 20.0 + ord(s[0]) % 7][:k])
    held = B.blocks(cat, channels, [1, 2], [0], lambda counts, *_: (counts.sum(), counts), of_sample, np.float64, block=7)
    weights = {(k, 0): np.array([of_channel(c)[:k] for c in channels], float) for k in (1, 2)}
    f = B.factor(held, weights, [1, 2], channels, np.float64, 1, ROUNDS, 1, TOLERANCE)
    acts = B.activities(f, scale=False)
    rounds = F.when(F.col("k") == 1, f.iterations[1, 0]).otherwise(f.iterations[2, 0])
    return acts.select("k", rounds.alias("iterations"), "sample", F.chr(65 + F.col("component")).alias("signature"), F.round("activity", 6).alias("activity"))


EM_ROUNDS = 12


def _mixture_sql() -> str:
    first = "t AS (SELECT sum(o_totalprice)::DOUBLE AS x FROM orders GROUP BY o_custkey), g AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM t), z AS (SELECT (x - mu) / sd AS z FROM t, g), m0 AS (SELECT -1.0::DOUBLE AS m0, 1.0::DOUBLE AS d0, 0.5::DOUBLE AS s0, 1.0::DOUBLE AS m1, 1.0::DOUBLE AS d1, 0.5::DOUBLE AS s1)"
    parts = [first]
    for i in range(EM_ROUNDS):
        parts.append(f"p{i} AS (SELECT z, 1 / (1 + exp(least(700, (ln(s0) - ln(d0) - (z - m0) ** 2 / (2 * d0 * d0)) - (ln(s1) - ln(d1) - (z - m1) ** 2 / (2 * d1 * d1))))) AS p FROM z, m{i})")
        parts.append(f"m{i + 1} AS (SELECT sum((1 - p) * z) / sum(1 - p) AS m0, sqrt(greatest(sum((1 - p) * z * z) / sum(1 - p) - (sum((1 - p) * z) / sum(1 - p)) ** 2, 0) + 1e-12) AS d0, avg(1 - p) AS s0, sum(p * z) / sum(p) AS m1, sqrt(greatest(sum(p * z * z) / sum(p) - (sum(p * z) / sum(p)) ** 2, 0) + 1e-12) AS d1, avg(p) AS s1 FROM p{i})")
    return f"WITH {', '.join(parts)} SELECT round(m0 * sd + mu, 2) AS low, round(d0 * sd, 2) AS low_sd, round(s0, 6) AS low_share, round(m1 * sd + mu, 2) AS high, round(d1 * sd, 2) AS high_sd FROM m{EM_ROUNDS}, g"


@query(_mixture_sql())
def mixture(spark, d):
    """Twelve rounds of the mixture of two normals over customers' order totals, as grouped sums."""
    totals = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    values = written(totals.groupBy(F.col("total").alias("x")).agg(F.count("*").alias("n")), "values")
    (m0, d0, s0), (m1, d1, _) = M.two_normals(values, EM_ROUNDS, 0.0)
    row = (round(m0, 2), round(d0, 2), round(s0, 6), round(m1, 2), round(d1, 2))
    return spark.createDataFrame([row], "low double, low_sd double, low_share double, high double, high_sd double")


@query(f"WITH {CATALOG_SQL} SELECT a.channel AS a, b.channel AS b, sum(a.cnt * b.cnt)::DOUBLE AS dot FROM catalog a JOIN catalog b USING (sample) WHERE a.channel <= b.channel GROUP BY 1, 2")
def svd_gram(spark, d):
    return M.gram(catalog(spark, d))


def _power_sql(rounds: int = 25) -> str:
    parts = ["g AS (SELECT a.channel AS a, b.channel AS b, sum(a.cnt * b.cnt)::DOUBLE AS dot FROM catalog a JOIN catalog b USING (sample) GROUP BY 1, 2)", "u0 AS (SELECT DISTINCT a AS channel, 1.0::DOUBLE AS x FROM g)"]
    for i in range(rounds):
        parts.append(f"y{i} AS (SELECT a AS channel, sum(dot * x) AS y FROM g JOIN u{i} ON b = channel GROUP BY 1)")
        parts.append(f"u{i + 1} AS (SELECT channel, y / sqrt((SELECT sum(y * y) FROM y{i})) AS x FROM y{i})")
    last = f"u{rounds}"
    return f"""WITH {CATALOG_SQL}, {', '.join(parts)}, v AS (SELECT sample, sum(cnt * x) AS s FROM catalog JOIN {last} USING (channel) GROUP BY 1), t AS (SELECT sqrt(sum(s *
 s)) AS value FROM v),
e AS (SELECT sqrt(greatest(1 - (SELECT value * value FROM t) / sum(cnt * cnt), 0)) AS error FROM catalog) SELECT sample, round(s / value, 6) AS y, round(value,
 3) AS value, round(error, 5) AS error FROM v, t, e"""


@query(_power_sql())
def svd_reconstruction(spark, d):
    """The first singular vector over samples, its value and the error that is left; the SQL multiplies by the Gram matrix until it stands."""
    cat = catalog(spark, d)
    left, values = M.singular(cat, 1)
    joined = M.right_vectors(cat, left, values).join(F.broadcast(values), "component")
    return six(joined.select("sample", "y", F.round("value", 3).alias("value"), F.round("error", 5).alias("error")), "y")



@query("SELECT l_returnflag AS flag, l_suppkey % 50 AS grp, count(*) AS n, median(l_extendedprice) AS median, quantile_disc(l_extendedprice, 0.9) AS high FROM lineitem GROUP BY 1, 2")
def group_medians(spark, d):
    """Exact medians and upper deciles of many groups by refinement."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 50).alias("grp"), F.col("l_extendedprice").alias("x"))
    n = F.col("n")
    found = O.order_statistics(rows, ("flag", "grp"), {"low": F.floor((n - 1) / 2), "top": F.floor(n / 2), "high": F.ceil(n * 0.9 - 1e-9) - 1})
    counts = rows.groupBy("flag", "grp").agg(F.count("*").alias("n"))
    return found.join(counts, ["flag", "grp"]).select("flag", "grp", "n", ((F.col("low") + F.col("top")) / 2).alias("median"), "high")


@query("""WITH e AS (SELECT o_custkey % 9 AS k, round(o_totalprice / 50) AS x FROM orders), p AS (SELECT k, false AS a, x FROM e UNION ALL SELECT o.k, true, e.x FROM
 (SELECT DISTINCT k FROM e) o, e WHERE e.k = 8),
r AS (SELECT k, a, x, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0e0 AS r FROM p),
s AS (SELECT k, sum(r) FILTER (WHERE a) AS s, count(*) FILTER (WHERE a)::DOUBLE AS n, count(*) FILTER (WHERE NOT a)::DOUBLE AS m, median(x) FILTER (WHERE NOT a)
 AS median FROM r GROUP BY 1)
SELECT k, round((s - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) AS z, median FROM s""")
def rank_tests(spark, d):
    """Order totals of eight groups of customers, each against a ninth."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 9).alias("k"), F.round(F.col("o_totalprice") / 50).alias("x"))
    return six(O.rank_tests(rows, 8), "z")


#: Pairs of suppliers by the difference of their parts' mean prices, for neighbours in a ring of keys and every seventh.
_PAIRS_SQL = """s AS (SELECT l_suppkey AS id, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1),
pairs AS (SELECT a.id AS a, b.id AS b, round(abs(a.x - b.x), 4) AS distance FROM s a JOIN s b ON b.id - a.id IN (1, 7, 11))"""


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, cuts AS (SELECT unnest([50.0, 200.0, 800.0])::DOUBLE AS cut), e AS (SELECT cut, a, b FROM cuts, pairs WHERE distance <= cut UNION
 ALL SELECT cut, b, a FROM cuts, pairs WHERE distance <= cut),
r(cut, id, other) AS (SELECT cut, id, id FROM cuts, s UNION SELECT r.cut, r.id, e.b FROM r JOIN e ON r.other = e.a AND r.cut = e.cut) SELECT cut, id, min(other)
 AS cluster FROM r GROUP BY 1, 2""")
def linkage_cuts(spark, d):
    """Single linkage of suppliers at three heights, from the edges of the spanning tree alone; the SQL takes all pairs."""
    means = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_extendedprice").alias("x"))
    means = written(means, "means")
    near = means.select(F.col("id").alias("a"), F.col("x").alias("p"), F.explode(F.array(*(F.col("id") + k for k in (1, 7, 11)))).alias("b"))
    pairs = near.join(means.select(F.col("id").alias("b"), F.col("x").alias("q")), "b").select("a", "b", F.round(F.abs(F.col("p") - F.col("q")), 4).alias("distance"))
    tree, _ = O.spanning_tree(pairs)
    return O.linkage_cuts(written(tree, "tree"), means, [50.0, 200.0, 800.0])


def _matching_sql(n: int = 10) -> str:
    """The least cost of matching the first i labels to any set of as many others, set by set."""
    parts = ["s0 AS (SELECT 0 AS used, 0.0::DOUBLE AS cost)"]
    for i in range(n):
        step = f"SELECT used | (1 << j) AS used, s{i}.cost + p.cost AS cost FROM s{i} JOIN p ON p.i = {i} AND used & (1 << j) = 0"
        parts.append(f"s{i + 1} AS (SELECT used, min(cost) AS cost FROM ({step}) GROUP BY 1)")
    return f"""WITH x AS (SELECT label, vec_id % 2 AS half, k, avg(x) AS m FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY ALL),
c AS (SELECT half, label, list(m ORDER BY k) AS v FROM x GROUP BY 1, 2), d AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS i FROM c),
p AS (SELECT a.i, b.i AS j, 1 - list_cosine_similarity(a.v, b.v) AS cost FROM d a, d b WHERE a.half = 0 AND b.half = 1), {", ".join(parts)}
SELECT {n}::BIGINT AS matched, round(min(cost), 4) AS cost FROM s{n}"""


@query(_matching_sql())
def matching(spark, d):
    """The matching of least cost between label centroids of vectors of even and odd number, by rounds of bids."""
    cells = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("dim", "x"))
    means = written(cells.groupBy("label", "half", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")), "means")
    side = lambda n, name, x: means.where(F.col("half") == n).select(F.col("label").alias(name), "dim", F.col("x").alias(x))
    sums = side(0, "a", "p").join(side(1, "b", "q"), "dim").groupBy("a", "b")
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    costs = sums.agg((1 - dot("p", "q") / F.sqrt(dot("p", "p") * dot("q", "q"))).alias("cost"))
    return assign(costs, tolerance=1e-6).agg(F.count("*").alias("matched"), F.round(F.sum("cost"), 4).alias("cost"))


REPLICATES = 40


@query(f"""WITH {CATALOG_SQL}, t AS (SELECT sample, sum(cnt) AS total, count(*) AS cells FROM catalog GROUP BY 1)
SELECT sample, total::BIGINT AS total, cells, {REPLICATES} AS replicates, total::BIGINT AS least, total::BIGINT AS greatest, 0::BIGINT AS new_cells, TRUE AS means_near, TRUE AS spread_near,
 round(total - sum(cnt * cnt) / total, 4) AS variance FROM t JOIN catalog USING (sample) GROUP BY sample, total, cells""")
def resample_totals(spark, d):
    """Resamples of each sample by splitting: totals stay, no new cell comes in, means lie within six deviations, and the cells' variances add up to the expected sum.

    variance is that expected sum; the sum over replicates may leave it by a quarter.
    """
    cells = catalog(spark, d).select("channel", "sample", "cnt")
    drawn = written(resample(cells, REPLICATES, seed=13), "resampled")
    by = drawn.groupBy("sample", "replicate").agg(F.sum("cnt").alias("n"))
    kept = by.groupBy("sample").agg(F.count("*").cast("int").alias("replicates"), F.min("n").alias("least"), F.max("n").alias("greatest"))
    moments = drawn.groupBy("channel", "sample").agg(F.sum("cnt").alias("sx"), F.sum(F.col("cnt") * F.col("cnt")).alias("sxx"))
    both = cells.join(moments, ["channel", "sample"], "full")
    total = cells.groupBy("sample").agg(F.sum("cnt").alias("total"))
    x, p = F.col("cnt"), F.col("cnt") / F.col("total")
    mean = F.coalesce("sx", F.lit(0)) / REPLICATES
    expected = x * (1 - p)
    squares = F.coalesce("sxx", F.lit(0)) - 2 * x * F.coalesce("sx", F.lit(0)) + REPLICATES * x * x
    out = both.join(total, "sample").groupBy("sample", "total").agg(
        F.count("cnt").alias("cells"), F.sum(F.col("cnt").isNull().cast("long")).alias("new_cells"),
        F.min(F.abs(mean - x) <= 6 * F.sqrt(expected / REPLICATES)).alias("means_near"),
        F.abs(F.sum(squares) / REPLICATES / F.sum(expected) - 1).alias("off"), F.round(F.sum(expected), 4).alias("variance"))
    return out.join(kept, "sample").select("sample", "total", "cells", "replicates", "least", "greatest", "new_cells", "means_near", (F.col("off") < 0.25).alias("spread_near"), "variance")
