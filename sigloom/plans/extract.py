"""Signature extraction as Spark jobs.

A catalogue of at most ``most_cells`` cells reaches the tasks by broadcast: all
ranks and replicates are rows of one task table, and each task bootstraps,
normalises and factors it in a numpy kernel. A larger one is never gathered:
``factor`` keeps its samples in blocks and goes through them round by round for
all ranks and replicates together. Restarts of the clustering are rows of a
task table, too. Channels are at most a few thousand.
"""

from __future__ import annotations

import datetime
import math
import platform
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.scalars import signature_name
from ..operators import matrix as M
from ..operators.matching import assign
from ..sources import channels as H
from ..sources.catalog import channel_order as channel_table
from ..sources.catalog import context_of, read_solutions
from ..sources.shared import dropped, written
from . import factor as B
from . import report as R

#: Cells of one dense catalogue; 50 million doubles are 400 MB.
MOST_CELLS = 50_000_000
#: Restarts of the clustering that one task tries.
RESTARTS = 5


@dataclass(frozen=True)
class Parameters:
    minimum_signatures: int = 1
    maximum_signatures: int = 25
    nmf_replicates: int = 100
    resample: bool = True
    seed: int = 0
    nmf_init: str = "random"
    precision: str = "single"
    matrix_normalization: str = "gmm"
    min_nmf_iterations: int = 10_000
    max_nmf_iterations: int = 1_000_000
    nmf_test_conv: int = 10_000
    nmf_tolerance: float = 1e-15
    clustering_distance: str = "cosine"
    clustering_restarts: int = 50
    stability: float = 0.8
    min_stability: float = 0.2
    combined_stability: float = 1.0
    allow_stability_drop: bool = False
    exome: bool = False
    most_cells: int = MOST_CELLS

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "parameter string, value string")


@dataclass
class Dense:
    channels: list[str]
    samples: list[str]
    v: np.ndarray

    @staticmethod
    def of(catalog: DataFrame) -> Dense:
        """The names are collected once each; cells come as numbers, a partition at a time."""
        names = {c: sorted(r[0] for r in catalog.select(c).distinct().collect()) for c in ("channel", "sample")}
        v = np.zeros((len(names["channel"]), len(names["sample"])))
        row, col = ({x: i for i, x in enumerate(names[c])} for c in ("channel", "sample"))
        for r in catalog.groupBy("channel", "sample").agg(F.sum(F.col("cnt").cast("double")).alias("cnt")).toLocalIterator():
            v[row[r.channel], col[r.sample]] = r.cnt
        return Dense(names["channel"], names["sample"], v)


def bootstrap(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A multinomial resample of each column; column totals stay."""
    n = v.sum(0)
    return np.stack([rng.multinomial(int(round(t)), c / t) if t > 0 else np.zeros(len(c)) for c, t in zip(v.T, n, strict=True)], 1).astype(np.float64)


_generator = B.generator


def _normalised(v: np.ndarray, norm: str, cutoff: float) -> np.ndarray:
    total = v.sum(0)
    if norm == "none":
        return v
    if norm == "log2":
        return v / total * np.log2(total)
    limit = {"gmm": cutoff, "100X": 100.0 * v.shape[0]}.get(norm)
    limit = float(int(norm)) if limit is None else limit
    return np.where(total > limit, v / total * limit, v)


def replicates(spark: SparkSession, dense: Dense, p: Parameters) -> DataFrame:
    """(k, replicate, w, h, metrics, iterations): one row per factorisation. Replicate r has the same noise at every k."""
    top = min(p.maximum_signatures, len(dense.samples))
    tasks = [(k, r) for k in range(min(p.minimum_signatures, top), top + 1) for r in range(p.nmf_replicates)]
    cutoff = K.hyper_cutoff(dense.v.sum(0), 100 * len(dense.channels)) if p.matrix_normalization == "gmm" else 0
    shared = spark.sparkContext.broadcast(dense.v)

    def run(frames):
        v = shared.value
        for pdf in frames:
            rows = []
            for k, r in zip(pdf["k"], pdf["replicate"], strict=True):
                x = bootstrap(v, _generator(p.seed, 0, int(r))) if p.resample else v
                x = np.maximum(x, M.EPS)
                total, x = x.sum(0), _normalised(x, p.matrix_normalization, cutoff)
                w, h, n = K.nmf(x, int(k), _generator(p.seed, 1, int(k), int(r)), p.nmf_init, 1.0, p.precision, p.min_nmf_iterations, p.max_nmf_iterations, p.nmf_test_conv, p.nmf_tolerance)
                w, h = w.astype(np.float64), h.astype(np.float64)
                metrics = K.similarities(x, w @ h)
                s = np.maximum(w.sum(0), 1e-300)
                w, h = w / s, h * s[:, None]
                h = np.round(h / np.maximum(h.sum(0), 1e-300) * total)
                rows.append((k, r, w.T.tolist(), h.tolist(), metrics.tolist(), n))
            yield pd.DataFrame(rows, columns=["k", "replicate", "w", "h", "metrics", "iterations"])

    table = spark.createDataFrame(tasks, "k int, replicate int").repartition(max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism)))
    return table.mapInPandas(run, "k int, replicate int, w array<array<double>>, h array<array<double>>, metrics array<double>, iterations int")


@dataclass
class Replicates:
    """factors: (k, replicate, w, metrics, iterations); activities: (k, replicate, component, sample, activity)."""

    factors: DataFrame
    activities: DataFrame


def dense_replicates(spark: SparkSession, dense: Dense, p: Parameters) -> Replicates:
    reps = written(replicates(spark, dense, p), "replicates")
    names = spark.createDataFrame(list(enumerate(dense.samples)), "i int, sample string")
    cells = reps.select("k", "replicate", F.posexplode("h").alias("component", "c")).select("k", "replicate", "component", F.posexplode("c").alias("i", "activity"))
    return Replicates(reps.drop("h"), cells.join(names, "i").select("k", "replicate", "component", "sample", "activity"))


def block_replicates(catalog: DataFrame, channels: list[str], n_samples: int, p: Parameters) -> Replicates:
    """The same without a dense copy: replicates in groups whose weights have at most ``factor.MOST_WEIGHTS`` numbers."""
    spark, top = catalog.sparkSession, min(p.maximum_signatures, n_samples)
    ks = list(range(min(p.minimum_signatures, top), top + 1))
    if p.precision not in ("single", "double"):
        raise ValueError(f"precision must be single or double, not {p.precision!r}")
    dtype = np.float32 if p.precision == "single" else np.float64
    cutoff = M.mixture_cutoff(M.totals(catalog), 100 * len(channels)) if p.matrix_normalization == "gmm" else 0

    def prepare(counts, replicate, sample):
        x = bootstrap(counts[:, None], B.of_sample(p.seed, replicate, sample)) if p.resample else counts[:, None]
        x = np.maximum(x, M.EPS)
        return x.sum(), _normalised(x, p.matrix_normalization, cutoff)[:, 0]

    def start(k, replicate, sample):
        return B.of_sample(p.seed + 1_000_003 * k, replicate, sample).random(k)

    size = max(1, B.MOST_WEIGHTS // (sum(ks) * len(channels)))
    parts = []
    for first in range(0, p.nmf_replicates, size):
        some = list(range(first, min(first + size, p.nmf_replicates)))
        held = written(B.blocks(catalog, channels, ks, some, prepare, start, dtype), "blocks")
        if p.nmf_init == "random":
            weights = {(k, r): _generator(p.seed, 1, k, r).random((len(channels), k)) for k in ks for r in some}
        else:
            held, weights = B.singular_starts(held, ks, channels, dtype, p.nmf_init, p.seed)
        f = B.factor(held, weights, ks, channels, dtype, p.min_nmf_iterations, p.max_nmf_iterations, p.nmf_test_conv, p.nmf_tolerance)
        parts.append((B.weights_table(spark, f).join(B.metrics(f), ["k", "replicate"]).select("k", "replicate", "w", "metrics", "iterations"), B.activities(f)))
    joined = [parts[0][0], parts[0][1]]
    for w, h in parts[1:]:
        joined = [joined[0].unionByName(w), joined[1].unionByName(h)]
    return Replicates(written(joined[0], "replicates"), joined[1])


def clustered(reps: DataFrame, p: Parameters) -> DataFrame:
    """(k, replicate, component, cluster, silhouette, restart): the best of the restarts of each rank.

    A rank's replicates are k x R short columns, a size fixed by the parameters.
    They go to as many tasks as it takes to try ``RESTARTS`` restarts each; of
    every task its best stays, then the best of each rank.
    """
    restarts = p.clustering_restarts if p.nmf_replicates > 1 else 1

    def run(key, pdf):
        k, part = int(key[0]), int(key[1])
        pdf = pdf.sort_values("replicate")
        stack = np.concatenate([np.array([list(c) for c in w]).T for w in pdf["w"]], 1)
        far = K.distances(stack, stack, p.clustering_distance)
        tried = {r: K.cluster(stack, k, _generator(p.seed, 2, k, r), p.clustering_distance, far=far) for r in range(part * RESTARTS, min(restarts, (part + 1) * RESTARTS))}
        best = max(tried, key=lambda r: (tried[r][1].mean(), -r))
        label, sil = tried[best]
        return pd.DataFrame({"k": k, "restart": best, "mean": sil.mean(), "replicate": np.repeat(pdf["replicate"].to_numpy(), k), "component": np.tile(np.arange(k), len(pdf)), "cluster": label, "silhouette": sil})

    tasks = reps.select("k", "replicate", "w", F.explode(F.sequence(F.lit(0), F.lit((restarts - 1) // RESTARTS))).alias("part"))
    tried = written(tasks.groupBy("k", "part").applyInPandas(run, "k int, restart int, mean double, replicate int, component int, cluster int, silhouette double"), "restarts")
    best = M.best_restarts(tried.select("k", "restart", F.col("mean").alias("silhouette")).distinct()).select("k", "restart")
    return tried.drop("mean").join(F.broadcast(best), ["k", "restart"])  # a row a rank


def signatures(reps: DataFrame, labels: DataFrame, channels: list[str]) -> DataFrame:
    """(k, cluster, channel, weight, sem): centroids of the clusters."""
    names = F.array(*(F.lit(c) for c in channels))
    cells = reps.select("k", "replicate", F.posexplode("w").alias("component", "c")).join(labels, ["k", "replicate", "component"])
    cells = cells.select("k", "cluster", F.posexplode("c").alias("i", "x"))
    return cells.groupBy("k", "cluster", "i").agg(F.avg("x").alias("weight"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem")).select("k", "cluster", F.element_at(names, F.col("i") + 1).alias("channel"), "weight", "sem")


def activity_errors(activities: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, cluster, sample, sem): standard errors of the replicates' activities; null for one replicate."""
    cells = activities.join(F.broadcast(labels.select("k", "replicate", "component", "cluster")), ["k", "replicate", "component"])  # a row a component of a replicate
    return cells.groupBy("k", "cluster", "sample").agg((F.stddev_samp("activity") / F.sqrt(F.count("activity"))).alias("sem"))


def activities(sigs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(k, sample, cluster, activity): non-negative fit of every sample at every rank.

    The weights, bounded by ranks x channels, go to the tasks once; samples stay
    where their counts were gathered.
    """
    told = sigs.toPandas()
    channels = sorted(told["channel"].unique())
    at = {c: i for i, c in enumerate(channels)}
    weights = {int(k): g.pivot_table(index="channel", columns="cluster", values="weight", fill_value=0.0).reindex(channels, fill_value=0.0).to_numpy(np.float64) for k, g in told.groupby("k")}
    shared = catalog.sparkSession.sparkContext.broadcast((at, weights))
    vs = catalog.groupBy("sample").agg(F.collect_list("channel").alias("channels"), F.collect_list(F.col("cnt").cast("double")).alias("counts"))

    def run(frames):
        at, weights = shared.value
        for pdf in frames:
            out = []
            for sample, names, counts in zip(pdf["sample"], pdf["channels"], pdf["counts"], strict=True):
                x = np.zeros(len(at))
                np.add.at(x, [at[c] for c in names], counts)
                out += [(k, sample, c, float(a)) for k, m in weights.items() for c, a in enumerate(K.refit(m, x))]
            yield pd.DataFrame(out, columns=["k", "sample", "cluster", "activity"])

    return vs.mapInPandas(run, "k int, sample string, cluster int, activity double")


def candidates(stats: list[dict], p: Parameters) -> list[int]:
    """The ranks that may be chosen, in order; the last is the base of the tests. Over at most a few dozen rows.

    Ranks that are stable enough, and of these only those at least as stable as
    the highest one; where none is stable enough, the lowest rank alone.
    """
    stats = sorted(stats, key=lambda s: s["k"])
    good = [s for s in stats if s["min_stability"] + s["avg_stability"] >= p.combined_stability and s["min_stability"] >= p.min_stability and s["avg_stability"] >= p.stability]
    if not good:
        return [stats[0]["k"]]
    top = good[-1]
    return [s["k"] for s in good if p.allow_stability_drop or s["avg_stability"] >= top["avg_stability"]]


def walk(ranks: list[int], lowest: int, tests: dict[int, tuple[float, float]], p: Parameters) -> tuple[int, dict[int, float]]:
    """The chosen rank and the p values that were looked at.

    From the base, the last of ``ranks``, lower candidates are tried in turn.
    ``tests``: a rank's z against the base, and its median error; the base's own
    median counts, too. The walk ends at a candidate whose errors are
    significantly larger, or at the ``lowest`` rank of all, and the candidate just
    above it is chosen. So the lowest rank is chosen only as the sole candidate.
    Where the candidates run out without either, the last one tried is chosen.
    """
    seen: dict[int, float] = {}
    chosen = ranks[-1]
    for k in reversed(ranks[:-1]):
        z, median = tests[k]
        seen[k] = math.erfc(abs(z) / math.sqrt(2))
        if (seen[k] < (1.0 if p.exome else 0.05) and median > tests[ranks[-1]][1]) or k == lowest:
            break
        chosen = k
    return chosen, seen


def choose(rank_stats: DataFrame, errors: DataFrame, p: Parameters, select: int | None = None) -> tuple[int, DataFrame]:
    """The rank and (k, chosen, considered, p_value); ``errors(k, x)`` are the samples' relative errors of each rank."""
    stats = [r.asDict() for r in rank_stats.select("k", "min_stability", "avg_stability").collect()]
    ranks = candidates(stats, p)
    tests = {r.k: (r.z or 0.0, r.median) for r in M.compare_ranks(errors.where(F.col("k").isin(ranks)), ranks[-1]).collect()}
    chosen, seen = walk(ranks, min(s["k"] for s in stats), tests, p)
    chosen = chosen if select is None else select
    marks = [(s["k"], s["k"] == chosen, s["k"] in seen or s["k"] == ranks[-1], seen.get(s["k"])) for s in stats]
    return chosen, rank_stats.sparkSession.createDataFrame(marks, "k int, chosen boolean, considered boolean, p_value double")


@dataclass
class Extraction:
    context: str
    chosen: int
    signatures: DataFrame
    activities: DataFrame
    activity_errors: DataFrame
    similarity: DataFrame
    convergence: DataFrame
    signature_stats: DataFrame
    rank_stats: DataFrame
    selection: DataFrame
    catalog: DataFrame
    replicates: DataFrame
    replicate_activities: DataFrame
    parameters: DataFrame
    metadata: DataFrame
    steps: list[DataFrame]

    def release(self) -> None:
        """Delete the intermediate tables; what is not written by then is gone."""
        dropped(*self.steps)

    def write(self, path: str, known: DataFrame | None = None, all_replicates: bool = False, export_probabilities: bool = False, collapse_to_sbs96: bool = True) -> None:
        """One directory per table, those of solutions by context and rank.

        ``suggested_solution`` holds the chosen rank's signatures and activities,
        and with ``known(channel, signature, weight)`` its decomposition.
        ``all_replicates``: every replicate's factors, too. ``export_probabilities``:
        the probability of each signature for each channel and sample.
        """
        by = lambda df, name: df.withColumn("context", F.lit(self.context)).write.partitionBy("context", "k").mode("overwrite").parquet(f"{path}/{name}")
        for name in ("signatures", "activities", "activity_errors", "similarity", "signature_stats", "convergence"):
            by(getattr(self, name), name)
        for name in ("rank_stats", "selection", "catalog", "parameters", "metadata"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        best = lambda df: df.where(F.col("k") == self.chosen)
        for name in ("signatures", "activities"):
            best(getattr(self, name)).write.mode("overwrite").parquet(f"{path}/suggested_solution/{name}")
        if known is not None:
            decompose(best(self.signatures), known, context=self.context, collapse_to_sbs96=collapse_to_sbs96).write.mode("overwrite").parquet(f"{path}/suggested_solution/decomposed")
        if all_replicates:
            by(self.replicates, "replicates")
            by(self.replicate_activities, "replicate_activities")
        if export_probabilities:
            M.probabilities(best(self.signatures).drop("k"), best(self.activities).drop("k")).write.mode("overwrite").parquet(f"{path}/suggested_solution/probabilities")


def write_text(e: Extraction, path: str, digits: bool = True) -> None:
    """The suggested solution as tab-separated matrices, channels and samples in order.

    ``signatures``: channels x signatures, weights as ``1.23E-04`` where ``digits``;
    ``activities``: samples x signatures. Signatures are columns, at most as many as the rank.
    """
    best = lambda df: df.where(F.col("k") == e.chosen)
    names = [r.signature for r in M.order_signatures(best(e.activities)).orderBy("position").collect()]
    weights = best(e.signatures).select("channel", "signature", "weight")
    R.write_wide(weights, f"{path}/signatures", "channel", "signature", "weight", names, channel_order(weights, e.context), digits)
    R.write_wide(best(e.activities), f"{path}/activities", "sample", "signature", "activity", names)


def channel_order(weights: DataFrame, context: str) -> DataFrame:
    """(channel, channel_idx): the order of the context's grammar, or by name where it has none."""
    spark = weights.sparkSession
    try:
        return channel_table(spark, context)
    except ValueError:
        names = sorted(r[0] for r in weights.select("channel").distinct().collect())  # channels are a few thousand at most
        return spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "channel string, channel_idx int")


def _metadata(spark: SparkSession, began: datetime.datetime, p: Parameters) -> DataFrame:
    """Versions, times, machine and seed of a run."""
    told = {"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "system": platform.platform(), "application": spark.sparkContext.applicationId, "seed": p.seed, "began": began.isoformat(), "ended": datetime.datetime.now().isoformat()}
    return spark.createDataFrame([(k, str(v)) for k, v in told.items()], "item string, value string")


def extract(catalog: DataFrame, p: Parameters | None = None, select: int | None = None) -> Extraction:
    """Clean the catalogue, factor it at every rank, measure stability and error, choose a rank.

    The steps' tables are written to the shared folder: lineage ends there, and
    nothing stays in Spark's cache. ``Extraction.release`` deletes them.
    """
    p, spark, began = p or Parameters(), catalog.sparkSession, datetime.datetime.now()
    catalog = written(M.drop_zero_samples(M.drop_null_samples(catalog)), "catalog")
    channels = sorted(r[0] for r in catalog.select("channel").distinct().collect())
    n_samples = catalog.agg(F.countDistinct("sample")).first()[0]
    if len(channels) * n_samples <= p.most_cells:
        reps = dense_replicates(spark, Dense.of(catalog), p)
    else:
        reps = block_replicates(catalog, channels, n_samples, p)
    labels = written(clustered(reps.factors, p), "labels")
    sigs = written(signatures(reps.factors, labels, channels), "signatures")
    acts = written(activities(sigs, catalog), "activities")
    order = acts.groupBy("k", "cluster").agg(F.sum("activity").alias("t"))
    context = context_of(len(channels))
    named = order.select("k", "cluster", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), "cluster")).alias("n"))
    named = F.broadcast(written(named.select("k", "cluster", signature_name(context, F.col("n") - 1).alias("signature")), "names"))  # a row a signature and rank
    sigs, acts = sigs.join(named, ["k", "cluster"]), acts.join(named, ["k", "cluster"])
    est = M.multiply(sigs.select("k", "channel", "signature", "weight"), acts.select("k", "sample", "signature", "activity"), ("k",)).persist()
    sims = written(M.similarity_table(catalog, est, ("k",)), "similarity")
    per = labels.groupBy("k", "cluster").agg(F.avg("silhouette").alias("s"))
    stab = per.groupBy("k").agg(F.round(F.min("s"), 2).alias("min_stability"), F.round(F.avg("s"), 2).alias("avg_stability"))
    stats = written(stab.join(M.frobenius_error(catalog, est, ("k",)), "k").select("k", "min_stability", "fro_err", "avg_stability"), "stats")
    est.unpersist()
    chosen, marks = choose(stats, sims.select("k", F.col("l2_pct").alias("x")), p, select)
    m = F.col("metrics")
    conv = reps.factors.select("k", "replicate", *(m[i].alias(n) for i, n in enumerate(["l1", "l1_pct", "l2", "l2_pct", "kl", "correlation"])), F.col("iterations").cast("long").alias("iterations"))
    selection = stats.join(marks, "k").join(M.selection_metrics(sims), "k")
    errors = activity_errors(reps.activities, labels).join(named, ["k", "cluster"]).select("k", "sample", "signature", "sem")
    told = R.signature_stats(per.join(named, ["k", "cluster"]).select("k", "signature", F.round("s", 2).alias("stability")), acts.select("k", "signature", "activity"))
    steps = [catalog, reps.factors, reps.activities, labels, sigs, acts, sims, stats]
    return Extraction(context, chosen, sigs.drop("cluster"), acts.drop("cluster"), errors, sims, conv, told, stats, selection, catalog, reps.factors.select("k", "replicate", "w"), reps.activities, p.table(spark), _metadata(spark, began, p), steps)


def estimate_solution(spark: SparkSession, path: str, catalog: DataFrame, p: Parameters | None = None, select: int | None = None) -> int:
    """Choose a rank again from written tables."""
    w, h = read_solutions(spark, path)
    est = M.multiply(w.select("k", "channel", "signature", "weight"), h.select("k", "sample", "signature", "activity"), ("k",))
    errors = M.similarity_table(catalog, est, ("k",)).select("k", F.col("l2_pct").alias("x"))
    return choose(spark.read.parquet(f"{path}/rank_stats"), errors, p or Parameters(), select)[0]


#: Pairs of signatures that are matched on the driver; more go through rounds of bids.
MOST_PAIRS = 250_000


def match_signatures(true: DataFrame, found: DataFrame, cutoff: float = 0.9, how: str = "cosine") -> dict:
    """Precision, recall and F1 of a one-to-one matching of two (channel, signature, weight) tables.

    Few signatures are matched exactly on the driver. Where they make more than
    ``MOST_PAIRS`` pairs, the matching is found by an auction over the table of
    pairs, within a thousandth of a distance a signature.
    """
    side = lambda df, mark: df.select(F.concat(F.lit(mark), "signature").alias("id"), F.col("channel").alias("dim"), F.col("weight").alias("x"))
    n, m = (df.select("signature").distinct().count() for df in (true, found))
    pairs = M.pairwise(side(true, "a").union(side(found, "b")), how).where("a like 'a%' and b like 'b%'")
    if n * m > MOST_PAIRS:
        matched = assign(pairs.select("a", "b", (1 - F.col("similarity")).alias("cost")), tolerance=1e-3)
        hits = matched.where(F.col("cost") <= 1 - cutoff).count()
    else:
        s = pairs.toPandas().pivot(index="a", columns="b", values="similarity").to_numpy()
        at = K.match(1 - s)
        hits = int(sum(s[i, j] >= cutoff for i, j in enumerate(at) if j >= 0))
    precision, recall = hits / m, hits / n
    f1 = round(2 * precision * recall / (precision + recall), 2) if hits else 0.0
    return {"tp": hits, "fp": m - hits, "fn": n - hits, "precision": round(precision, 2), "recall": round(recall, 2), "f1": f1}


def decompose(sigs: DataFrame, known: DataFrame, add: float = 0.05, remove: float = 0.01, context: str = "", collapse_to_sbs96: bool = True) -> DataFrame:
    """(signature, known, share): each found signature as a mixture of few known ones; ``known(channel, signature, weight)`` is supplied by the user.

    Signatures of a finer context of substitutions are summed to SBS96 first; where that is not wanted, ``known`` has their channels.
    """
    if collapse_to_sbs96 and context in H.STRANDS and context != "SBS96":
        sigs = H.collapse(sigs, context, "SBS96", "weight", ("signature",))
    k = known.toPandas().pivot_table(index="channel", columns="signature", values="weight", fill_value=0.0)
    shared = sigs.sparkSession.sparkContext.broadcast((list(k.index), list(k.columns), k.to_numpy()))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        channels, names, m = shared.value
        t = pdf.set_index("channel")["weight"].reindex(channels).fillna(0.0).to_numpy()
        x = K.decompose(t, m, add, remove)
        on = np.flatnonzero(x)
        return pd.DataFrame({"signature": key[0], "known": [names[i] for i in on], "share": x[on]})

    return sigs.select("signature", "channel", "weight").groupBy("signature").applyInPandas(run, "signature string, known string, share double")
