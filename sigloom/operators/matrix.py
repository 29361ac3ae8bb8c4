"""Relational operators on long matrices: catalogue (channel, sample, cnt), W (channel, signature, weight), H (sample, signature, activity)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import ordered as O

EPS = 1e-4


def totals(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("sample").agg(F.sum("cnt").alias("total"))


def drop_null_samples(catalog: DataFrame) -> DataFrame:
    bad = catalog.where(F.col("cnt").isNull() | F.isnan(F.col("cnt").cast("double"))).select("sample").distinct()
    return catalog.join(bad, "sample", "left_anti")


def drop_zero_samples(catalog: DataFrame) -> DataFrame:
    return catalog.join(totals(catalog).where("total > 0").select("sample"), "sample", "left_semi")


def floor_cells(catalog: DataFrame, least: float = EPS) -> DataFrame:
    return catalog.withColumn("cnt", F.greatest(F.col("cnt").cast("double"), F.lit(least)))


def normalise(catalog: DataFrame, norm: str = "100X", cutoff: float = 10_000_000, rows: int | None = None) -> DataFrame:
    """``gmm``, ``100X``, ``log2``, ``none`` or a number as text; bad text raises. ``rows``: channels, counted where not given."""
    if norm == "none":
        return catalog.withColumn("cnt", F.col("cnt").cast("double"))
    v, total = F.col("cnt").cast("double"), F.sum("cnt").over(Window.partitionBy("sample")).cast("double")
    if norm == "log2":
        return catalog.withColumn("cnt", v / total * F.log2(total))
    if norm == "100X":
        cutoff = 100 * (rows if rows is not None else catalog.select("channel").distinct().count())
    elif norm != "gmm":
        try:
            cutoff = int(norm)
        except ValueError:
            raise ValueError(f"normalisation must be gmm, 100X, log2, none or a number, not {norm!r}") from None
    return catalog.withColumn("cnt", F.when(total > cutoff, v / total * F.lit(float(cutoff))).otherwise(v))


def denormalise(activities: DataFrame, original: DataFrame) -> DataFrame:
    """Scale each sample's activities to ``original(sample, total)`` and round half to even."""
    share = F.col("activity") / F.sum("activity").over(Window.partitionBy("sample"))
    return activities.withColumn("share", share).join(original, "sample").select("sample", "signature", F.bround(F.col("share") * F.col("total"), 0).alias("activity"))


def l1_normalise(w: DataFrame) -> DataFrame:
    return w.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("signature")))


def rescale(w: DataFrame, h: DataFrame) -> DataFrame:
    """Activities that keep W x H when W's columns are scaled to sum 1."""
    return h.join(w.groupBy("signature").agg(F.sum("weight").alias("s")), "signature").select("sample", "signature", (F.col("activity") * F.col("s")).alias("activity"))


def multiply(w: DataFrame, h: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """W x H: every sample meets every channel once; ``by`` names columns that tell several solutions apart.

    The signatures are few, so neither a join nor a sum is dealt by them: the
    channels' weights, channels x signatures numbers, go to every task, and the
    samples are dealt to the tasks. A cell is made whole where it arises, and no
    task holds cells. Cells without a signature that both sides have are left out.
    """
    tasks = 4 * h.sparkSession.sparkContext.defaultParallelism
    names = lambda side, x: F.transform(F.array_sort(F.collect_list(F.struct("signature", F.col(x).cast("double").alias("x")))), lambda e: e[side])
    arrays = lambda df, key, x, s: df.where("signature is not null").groupBy(*by, key).agg(names("signature", x).alias(f"{s}n"), names("x", x).alias(f"{s}x"))
    channels = arrays(w, "channel", "weight", "w").withColumn("single", F.size(F.array_distinct("wn")) == F.size("wn"))
    samples = arrays(h.repartition(tasks, *by, "sample"), "sample", "activity", "h")
    both = samples.join(F.broadcast(channels), list(by)) if by else samples.crossJoin(F.broadcast(channels))
    times = lambda a, b: a * b
    mixed = F.transform("wn", lambda n, i: F.transform(F.filter(F.arrays_zip("hn", "hx"), lambda e: e["hn"] == n), lambda e: e["hx"] * F.get("wx", i)))
    products = F.when(F.col("single") & (F.col("wn") == F.col("hn")), F.zip_with("wx", "hx", times)).otherwise(F.flatten(mixed))
    est = F.aggregate("products", F.lit(None).cast("double"), lambda t, x: F.coalesce(t + x, t, x))
    return both.select(*by, "channel", "sample", products.alias("products")).where(F.size("products") > 0).select(*by, "channel", "sample", est.alias("est"))


def _ratio(catalog: DataFrame, w: DataFrame, h: DataFrame, beta: float, side: str) -> DataFrame:
    """(side, signature, r): by what a multiplicative update of the divergence ``beta`` scales the weights or activities.

    The estimate is dense, so cells that the catalogue lacks count as zeros. One
    join makes the estimate; the other factor is joined to its cells on the
    dimension that is summed over.
    """
    cells = multiply(w, h).join(catalog.select("channel", "sample", F.col("cnt").cast("double").alias("v")), ["channel", "sample"], "left")
    up, down = F.coalesce("v", F.lit(0.0)) * F.pow("est", F.lit(beta - 2)), F.pow("est", F.lit(beta - 1))
    other, on, x = (h, "sample", "activity") if side == "channel" else (w, "channel", "weight")
    both = cells.select("channel", "sample", up.alias("up"), down.alias("down")).join(other, on)
    return both.groupBy(side, "signature").agg(F.try_divide(F.sum(F.col("up") * F.col(x)), F.sum(F.col("down") * F.col(x))).alias("r"))


def nmf_round(catalog: DataFrame, w: DataFrame, h: DataFrame, beta: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """One round of multiplicative updates as joins and grouped sums: W then H for beta 1 (KL), else H then W.

    A factor whose denominator is zero becomes zero.
    """

    def weights(w: DataFrame, h: DataFrame) -> DataFrame:
        return w.join(_ratio(catalog, w, h, beta, "channel"), ["channel", "signature"]).select("channel", "signature", (F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("weight"))

    def activities(w: DataFrame, h: DataFrame) -> DataFrame:
        return h.join(_ratio(catalog, w, h, beta, "sample"), ["sample", "signature"]).select("sample", "signature", (F.col("activity") * F.coalesce("r", F.lit(0.0))).alias("activity"))

    if beta == 1:
        w = weights(w, h)
        return w, activities(w, h)
    h = activities(w, h)
    return weights(w, h), h


def probabilities(w: DataFrame, h: DataFrame) -> DataFrame:
    both = w.join(h, "signature").withColumn("x", F.col("weight") * F.col("activity"))
    return both.select("channel", "sample", "signature", F.try_divide("x", F.sum("x").over(Window.partitionBy("channel", "sample"))).alias("probability"))


def _cosine(a: Column, b: Column) -> Column:
    return F.when((F.sum(a) == 0) | (F.sum(b) == 0), 0.0).otherwise(F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))))


def _pearson(a: str, b: str) -> Column:
    """Null where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pairwise(vectors: DataFrame, how: str = "cosine") -> DataFrame:
    """``vectors(id, dim, x)`` -> (a, b, similarity) for a < b, as one join on the dimension.

    The number of ids is that of samples or signatures, not of events.
    """
    a = vectors.select(F.col("id").alias("a"), "dim", F.col("x").cast("double").alias("xa"))
    b = vectors.select(F.col("id").alias("b"), "dim", F.col("x").cast("double").alias("xb"))
    both = a.join(b, "dim").where("a < b").groupBy("a", "b")
    if how == "cosine":
        return both.agg(_cosine(F.col("xa"), F.col("xb")).alias("similarity"))
    zero = (F.sum("xa") == 0) | (F.sum("xb") == 0)
    return both.agg(F.when(zero, 0.0).otherwise(_pearson("xa", "xb")).alias("similarity"))


def against(catalog: DataFrame, est: DataFrame) -> DataFrame:
    """The estimate's cells with ``v``, the catalogue's count, 0 where it has none."""
    cells = catalog.select("channel", "sample", F.col("cnt").cast("double").alias("v"))
    return est.join(cells, ["channel", "sample"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def similarity_table(catalog: DataFrame, est: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Eight measures per sample (and solution, ``by``); percentages come from the rounded norms, an infinite divergence is 1000.

    The estimate names the cells: those that the catalogue lacks are zeros.
    """
    both = against(catalog, est).select(*by, "channel", "sample", "v", F.col("est").cast("double").alias("q"))
    w = Window.partitionBy(*by, "sample")
    both = both.withColumns({"pv": F.try_divide("v", F.sum("v").over(w)), "pq": F.try_divide("q", F.sum("q").over(w))})
    kl = F.sum(F.when(F.col("pv") == 0, 0.0).when(F.col("pq") == 0, float("inf")).otherwise(F.col("pv") * F.ln(F.when(F.col("pq") > 0, F.col("pv") / F.col("pq")))))
    d, total = F.col("v") - F.col("q"), F.sum("v")
    l1, l2 = F.round(F.sum(F.abs(d)), 3), F.round(F.sqrt(F.sum(d * d)), 3)
    zero = (total == 0) | (F.sum("q") == 0)
    return both.groupBy(*by, "sample").agg(
        total.cast("long").alias("total_mutations"), F.round(_cosine(F.col("v"), F.col("q")), 3).alias("cosine"), l1.alias("l1"), F.round(F.try_divide(l1 * 100, total), 3).alias("l1_pct"), l2.alias("l2"),
        F.round(F.try_divide(l2 * 100, F.sqrt(F.sum(F.col("v") * F.col("v")))), 3).alias("l2_pct"), F.when(kl == float("inf"), 1000.0).otherwise(F.round(kl, 5)).alias("kl"), F.round(F.when(zero, 0.0).otherwise(_pearson("v", "q")), 3).alias("correlation"))


def frobenius_error(catalog: DataFrame, est: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relative error of all cells; the estimate names them, those that the catalogue lacks are zeros."""
    d = F.col("v") - F.col("est")
    return against(catalog, est).groupBy(*by).agg(F.round(F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(F.col("v") * F.col("v")))), 4).alias("fro_err"))


def kl_loss(catalog: DataFrame, est: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The generalised divergence of the estimate; a cell of zero, absent or not, adds its estimate alone."""
    v, q = F.col("v"), F.col("est")
    cell = F.when(v > 0, v * F.ln(v / F.greatest(q, F.lit(1e-300))) - v).otherwise(0.0) + q
    return against(catalog, est).groupBy(*by).agg(F.sum(cell).alias("loss"))


def _medians(similarity: DataFrame, by: tuple[str, ...], names: list[str]) -> DataFrame:
    """Exact medians of several measures by group, one column each."""
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("x")) for n in names))).alias("m")
    found = O.medians(similarity.select(*by, one).select(*by, "m.*"), (*by, "measure"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("measure") == n, F.col("median"))).alias(f"median_{n}") for n in names))


def metric_summary(similarity: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means, medians and extremes of the measures over samples."""
    asked = {
        "mean_cosine": (F.avg, "cosine"), "max_cosine": (F.max, "cosine"), "max_l1_pct": (F.max, "l1_pct"), "max_l2_pct": (F.max, "l2_pct"), "mean_kl": (F.avg, "kl"), "max_kl": (F.max, "kl"),
        "mean_corr": (F.avg, "correlation"), "min_corr": (F.min, "correlation"),
    }
    middle = _medians(similarity, by, ["l1_pct", "l2_pct"])
    rest = similarity.groupBy(*by).agg(*(f(c).alias(n) for n, (f, c) in asked.items()))
    return rest.join(middle, list(by)) if by else rest.join(middle)  # one row each without groups


def selection_metrics(similarity: DataFrame) -> DataFrame:
    """By rank k, the ten measures of the selection table, rounded as reports want them."""
    x = similarity.withColumn("far", 1 - F.col("cosine"))
    asked = [
        ("max_l1_pct", F.max("l1_pct"), 2), ("max_l2_pct", F.max("l2_pct"), 2), ("mean_kl", F.avg("kl"), 4), ("max_kl", F.max("kl"), 4), ("mean_cosine_distance", F.avg("far"), 3),
        ("max_cosine_distance", F.max("far"), 3), ("mean_correlation", F.avg("correlation"), 3), ("min_correlation", F.min("correlation"), 3),
    ]
    middle = _medians(similarity, ("k",), ["l1_pct", "l2_pct"]).select("k", F.round("median_l1_pct", 2).alias("mean_l1_pct"), F.round("median_l2_pct", 2).alias("mean_l2_pct"))
    return x.groupBy("k").agg(*(F.round(c, n).alias(name) for name, c, n in asked)).join(middle, "k")


def centroids(replicates: DataFrame) -> DataFrame:
    """``replicates(cluster, replicate, channel, weight)`` -> mean and standard error (null for one replicate)."""
    return replicates.groupBy("cluster", "channel").agg(F.avg("weight").alias("mean"), (F.stddev_samp("weight") / F.sqrt(F.count("weight"))).alias("sem"))


#: Numbers of all clusters' sums that may go to every task; 4 million doubles are 32 MB.
MOST_SUMS = 4_000_000


def silhouettes(points: DataFrame) -> DataFrame:
    """``points(id, cluster, vector)`` -> cosine silhouette of each point; 0 in a cluster of one.

    Distances to whole clusters need only each cluster's sum of unit vectors, so
    no pair of points is formed. Where these sums have at most ``MOST_SUMS``
    numbers they go to every task as one array; beyond that points and sums meet
    on the clusters' blocks, and the points' own rows carry the best so far.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = points.select("id", "cluster", F.transform("vector", lambda x: x.cast("double")).alias("v")).withColumn("v", F.transform("v", lambda x: x / norm(F.col("v"))))
    sums = unit.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    other = written(sums.groupBy(F.col("cluster").alias("c")).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("s")), "sums")
    size = other.agg(F.count("*").alias("m"), F.max(F.size("s")).alias("d")).first()
    blocks = max(1, -(-(size.m or 0) * (size.d or 0) // MOST_SUMS))
    dot = lambda v, s: F.aggregate(F.zip_with(v, s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    best = None
    for k in range(blocks):
        own = other if blocks == 1 else other.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == k)
        held = F.broadcast(own.agg(F.collect_list(F.struct("c", "n", "s")).alias("sums")))  # one row of at most MOST_SUMS numbers
        told = unit.join(held, F.lit(True)).withColumn("far", F.transform("sums", lambda c: F.struct(c.c.alias("c"), c.n.alias("n"), dot(F.col("v"), c.s).alias("dot"))))
        mine = F.filter("far", lambda c: c.c == F.col("cluster"))
        a = F.when(F.size(mine) > 0, F.try_divide(mine[0]["n"] - mine[0]["dot"], mine[0]["n"] - 1))
        b = F.array_min(F.transform(F.filter("far", lambda c: c.c != F.col("cluster")), lambda c: (c.n - c.dot) / c.n))
        part = told.select("id", "cluster", a.alias("a"), b.alias("b"))
        best = part if best is None else best.union(part)
    ab = best if blocks == 1 else best.groupBy("id", "cluster").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return ab.select("id", "cluster", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def rank_filter(stats: DataFrame, stability: float = 0.8, min_stability: float = 0.2, combined: float = 1.0) -> DataFrame:
    return stats.where((F.col("min_stability") + F.col("avg_stability") >= combined) & (F.col("min_stability") >= min_stability) & (F.col("avg_stability") >= stability))


#: The values of a rank test are cut at so many quantiles into ranges that are ranked apart.
RANGES = 64


def rank_sum(values: DataFrame) -> DataFrame:
    """``values(grp, x)`` of two groups 'a' and 'b': z of a's rank sum, with average ranks for ties and no tie correction.

    Equal values are counted first; ranges of values between quantiles then get
    their running counts side by side, and each range the count of those before.
    """
    counts = values.groupBy("x").agg(F.count(F.when(F.col("grp") == "a", 1)).alias("na"), F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    at = sum(((F.col("x") > F.lit(c)).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    counts = counts.withColumn("range", at)
    sizes = counts.groupBy("range").agg(F.sum("n").alias("size"))  # at most RANGES rows
    offset = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("offset"))
    within = F.sum("n").over(Window.partitionBy("range").orderBy("x")) - F.col("n")
    ranked = counts.withColumn("within", within).join(F.broadcast(offset), "range").withColumn("r", F.col("offset") + F.col("within") + (F.col("n") + 1) / F.lit(2.0))
    n1, both = F.sum("na").cast("double"), F.sum("n").cast("double")
    s = F.sum(F.col("na") * F.col("r"))
    return ranked.agg(s.alias("rank_sum"), ((s - n1 * (both + 1) / 2.0) / F.sqrt(n1 * (both - n1) * (both + 1) / 12.0)).alias("z"))


def compare_ranks(errors: DataFrame, base: int) -> DataFrame:
    """``errors(k, x)`` -> (k, z, median): the rank test of the base's errors against those of each other rank, and that rank's median."""
    return O.rank_tests(errors, base)


def best_restarts(tried: DataFrame) -> DataFrame:
    """``tried(k, restart, silhouette)`` -> the restart of the highest silhouette of each rank, the first of equals."""
    best = tried.groupBy("k").agg(F.max(F.struct("silhouette", (-F.col("restart")).alias("back"))).alias("m"))
    return best.select("k", (-F.col("m.back")).alias("restart"), "m.silhouette")


#: Of a mixture: mean, deviation and share of the lower and the upper normal, in units of the values.
Normals = tuple[tuple[float, float, float], tuple[float, float, float]]


def two_normals(values: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> Normals:
    """A mixture of two normals over ``values(x, n)``, n equal values each, by expectation and maximisation.

    A round is one grouped sum of weighted counts, sums and squares: nothing but
    these six numbers comes to the driver. It starts one deviation below and
    above the mean, and ends where the means move by less than ``tolerance``
    deviations. Values are centred and scaled for the sums.
    """
    mu, sd = values.agg(F.sum(F.col("x") * F.col("n")) / F.sum("n"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") * F.col("n")) / F.sum("n") - F.pow(F.sum(F.col("x") * F.col("n")) / F.sum("n"), F.lit(2))))).first()
    scale = max(sd, 1e-9)
    z = (F.col("x") - F.lit(mu)) / F.lit(scale)
    now = [(-1.0, 1.0, 0.5), (1.0, 1.0, 0.5)]
    for _ in range(rounds):
        p = upper_share(z, now)
        sums = []
        for q in (1 - p, p):
            w = q * F.col("n")
            sums += [F.sum(w), F.sum(w * z), F.sum(w * z * z)]
        r = values.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        size, new = r[0] + r[3], []
        for n, a, b in (r[:3], r[3:]):
            n = max(n, 1e-9)
            new.append((a / n, max(b / n - (a / n) ** 2, 0.0) + 1e-12, n / size))
        new = [(m, v**0.5, s) for m, v, s in new]
        moved = max(abs(new[i][0] - now[i][0]) for i in (0, 1))
        now = new
        if moved < tolerance:
            break
    return tuple((m * scale + mu, d * scale, s) for m, d, s in now)


def upper_share(x: Column, normals) -> Column:
    """The posterior of the second normal."""
    log = [F.lit(math.log(max(s, 1e-300)) - math.log(d)) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * d * d) for m, d, s in normals]
    return 1 / (1 + F.exp(F.least(F.lit(700.0), log[0] - log[1])))


def mixture_cutoff(totals: DataFrame, least: float, rounds: int = 200, tolerance: float = 1e-9) -> int:
    """The total that normalisation cuts at: mean plus two deviations of the ordinary samples, at least ``least``.

    Totals fall into two normals; the larger group alone is looked at again as
    long as the groups' means are at least four of its deviations apart. Equal
    totals are one row from the start.
    """
    values = written(totals.where("total is not null").groupBy(F.col("total").cast("double").alias("x")).agg(F.count("*").alias("n")), "totals")
    of = lambda c: (F.sum(F.when(c, F.col("n"))), F.sum(F.when(c, F.col("n") * F.col("x"))), F.sum(F.when(c, F.col("n") * F.col("x") * F.col("x"))))
    spread = lambda n, a, b: (a / n, max(b / n - (a / n) ** 2, 0.0) ** 0.5)
    while True:
        n, a, b = values.agg(*of(F.lit(True))).first()
        if not n:
            return int(least)
        if n > 2:
            normals = two_normals(values, rounds, tolerance)
            upper = upper_share(F.col("x"), normals) > 0.5
            r = values.agg(*of(~upper), *of(upper)).first()
            low, high = r[:3], r[3:]
            if low[0] and high[0]:
                big, small = (high, low) if high[0] > low[0] else (low, high)
                (mean, sd), (other, _) = spread(*big), spread(*small)
                if abs(mean - other) >= 4 * sd:
                    values = values.where(upper if big is high else ~upper)
                    continue
        mean, sd = spread(n, a, b)
        return max(int(mean + 2 * sd), int(least))


def gram(catalog: DataFrame) -> DataFrame:
    """(a, b, dot) for channels a <= b: sums over samples of the products of their counts, one join by sample."""
    left = catalog.select("sample", F.col("channel").alias("a"), F.col("cnt").cast("double").alias("x"))
    right = catalog.select("sample", F.col("channel").alias("b"), F.col("cnt").cast("double").alias("y"))
    return left.join(right, "sample").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


#: Channels of a Gram matrix that the driver takes apart; 5,000 squared are 200 MB.
MOST_CHANNELS = 5000


def singular(catalog: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Truncated singular value decomposition: (channel, component, x) and (component, value, error).

    ``error``: the relative error of all cells when components up to this one are kept. Only
    the Gram matrix of the channels comes to the driver; the samples may be any number.
    """
    cells = gram(catalog)
    channels = sorted(r[0] for r in cells.select("a").distinct().collect())
    if len(channels) > MOST_CHANNELS:
        raise ValueError(f"{len(channels)} channels exceed MOST_CHANNELS")
    at, matrix = {c: i for i, c in enumerate(channels)}, np.zeros((len(channels), len(channels)))
    for r in cells.toLocalIterator():
        matrix[at[r.a], at[r.b]] = matrix[at[r.b], at[r.a]] = r.dot
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:k]
    spark, left = catalog.sparkSession, np.sqrt(np.maximum(1 - np.cumsum(np.maximum(values[order], 0)) / max(matrix.trace(), 1e-300), 0))
    u = [(c, j, float(vectors[i, o] * (-1 if vectors[np.abs(vectors[:, o]).argmax(), o] < 0 else 1))) for j, o in enumerate(order) for i, c in enumerate(channels)]
    sizes = [(j, float(max(values[o], 0) ** 0.5), float(left[j])) for j, o in enumerate(order)]
    return spark.createDataFrame(u, "channel string, component int, x double"), spark.createDataFrame(sizes, "component int, value double, error double")


def right_vectors(catalog: DataFrame, left: DataFrame, values: DataFrame) -> DataFrame:
    """(sample, component, y): the samples' singular vectors, a join and a grouped sum."""
    dots = catalog.join(F.broadcast(left), "channel").groupBy("sample", "component").agg(F.sum(F.col("cnt") * F.col("x")).alias("s"))  # channels x k rows
    return dots.join(F.broadcast(values), "component").select("sample", "component", F.try_divide("s", "value").alias("y"))


def cutoff_stats(catalog: DataFrame) -> DataFrame:
    return totals(catalog).agg(F.floor(F.avg("total") + 2 * F.stddev_pop("total")).cast("long").alias("cutoff"))


def split_samples(catalog: DataFrame, edges: list[float]) -> DataFrame:
    """Samples by the interval (lo, hi] of their total."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("total") <= e, i).otherwise(bucket)
    return totals(catalog).withColumn("bucket", bucket)


def order_signatures(activities: DataFrame) -> DataFrame:
    """Signatures by total, largest first, ties by name: (signature, total, position)."""
    t = activities.groupBy("signature").agg(F.sum("activity").cast("long").alias("total"))
    return t.withColumn("position", F.row_number().over(Window.orderBy(F.desc("total"), "signature")))


def majority(labels: DataFrame) -> DataFrame:
    """The most frequent label, the lowest of equals."""
    return labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)


def single_linkage(pairs: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """(id, cluster): clusters of single linkage of ``points(id)`` cut at ``distance``, named by their smallest id."""
    return O.linkage_cuts(pairs, points, [distance]).drop("cut")
