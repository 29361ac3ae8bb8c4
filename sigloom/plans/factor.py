"""Factorisation of a catalogue with any number of samples, for all ranks and replicates at once.

The catalogue never passes the driver: samples lie in blocks of rows, each with
its counts and, for every rank, its activities. A round is one pass over the
blocks with the weights of all (rank, replicate) keys broadcast: activities are
updated where they lie, and what the next weights need, sums over samples, is
added up by key within tasks and then between them. Keys whose loss has
converged leave the rounds. Weights are channels x rank numbers a key, so their
size does not depend on the samples; keys go in groups of a bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.shared import written

#: Samples of a block; rounds after which the blocks are written, so that lost ones start there; numbers of the weights of one group of keys.
BLOCK, WRITE_EVERY, MOST_WEIGHTS = 512, 20, 20_000_000

Key = tuple[int, int]
_STATE = "replicate int, samples array<string>, total array<double>, v binary, h array<binary>, k int, sums binary, loss double"
_ARROW = pa.schema([
    ("replicate", pa.int32()), ("samples", pa.list_(pa.string())), ("total", pa.list_(pa.float64())), ("v", pa.binary()), ("h", pa.list_(pa.binary())), ("k", pa.int32()), ("sums", pa.binary()), ("loss", pa.float64()),
])


@dataclass
class Factors:
    """weights: by (k, replicate), channels x k; iterations: at convergence, or 0; blocks: with the last activities."""

    ks: list[int]
    channels: list[str]
    dtype: type
    weights: dict[Key, np.ndarray]
    iterations: dict[Key, int]
    losses: dict[Key, float]
    blocks: DataFrame


def generator(*path: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence(path[0], spawn_key=path[1:])))


def of_sample(seed: int, replicate: int, sample: str) -> np.random.Generator:
    """A sample's own generator, whatever block it lies in."""
    return generator(seed, 0, replicate, zlib.crc32(sample.encode()))


def sample_rows(catalog: DataFrame, channels: list[str]) -> DataFrame:
    """(sample, cells): the cells of each sample by number of channel."""
    order = catalog.sparkSession.createDataFrame([(c, i) for i, c in enumerate(channels)], "channel string, i int")
    cells = catalog.groupBy("channel", "sample").agg(F.sum(F.col("cnt").cast("double")).alias("cnt"))
    return cells.join(F.broadcast(order), "channel").groupBy("sample").agg(F.collect_list(F.struct("i", "cnt")).alias("cells"))  # channels at most


def _block_row(replicate: int, samples: list[str], total: np.ndarray, v: np.ndarray, h: list[np.ndarray]) -> dict:
    return {"replicate": replicate, "samples": samples, "total": total.tolist(), "v": v.tobytes(), "h": [x.tobytes() for x in h], "k": None, "sums": None, "loss": None}


def blocks(catalog: DataFrame, channels: list[str], ks: list[int], replicates: list[int], prepare: Callable, start: Callable, dtype: type, block: int = BLOCK) -> DataFrame:
    """The samples of every replicate in blocks.

    ``prepare(counts, replicate, sample)`` gives (total, counts to factor), and
    ``start(k, replicate, sample)`` a sample's first activities. A replicate's
    samples are spread over tasks by a hash of their name.
    """
    spark = catalog.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = sample_rows(catalog, channels).select("sample", "cells", F.explode(F.array(*map(F.lit, replicates))).alias("replicate"))
    dealt = rows.repartition(parts, "replicate", F.pmod(F.hash("sample"), F.lit(parts))).sortWithinPartitions("replicate", "sample")
    n = len(channels)

    def run(batches):
        held: list[tuple] = []

        def out():
            replicate = held[0][0]
            v = np.stack([x[3] for x in held], 1).astype(dtype)
            h = [np.stack([start(k, replicate, x[1]) for x in held], 1).astype(dtype) for k in ks]
            row = _block_row(replicate, [x[1] for x in held], np.array([x[2] for x in held]), v, h)
            held.clear()
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for sample, cells, replicate in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (held[0][0] != replicate or len(held) >= block):
                    yield out()
                counts = np.zeros(n)
                for c in cells:
                    counts[c["i"]] = c["cnt"] or 0.0
                held.append((replicate, sample, *prepare(counts, replicate, sample)))
        if held:
            yield out()

    return dealt.mapInArrow(run, _STATE)


def _rows_of(batch: pa.RecordBatch, n: int, dtype: type) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """(row, replicate, counts, activities) of the blocks in a batch."""
    for i in range(batch.num_rows):
        if batch.column(3)[i].is_valid:
            v = np.frombuffer(batch.column(3)[i].as_buffer(), dtype).reshape(n, -1)
            yield i, batch.column(0)[i].as_py(), v, [x.as_buffer() for x in batch.column(4)[i].values]


def _add(sums: dict, key: Key, total: np.ndarray, loss: float) -> None:
    if key in sums:
        sums[key][0] += total
        sums[key][1] += loss
    else:
        sums[key] = [total, loss]


def _sum_rows(sums: dict) -> list[dict]:
    empty = {"samples": None, "total": None, "v": None, "h": None}
    return [{**empty, "replicate": r, "k": k, "sums": total.tobytes(), "loss": loss} for (k, r), (total, loss) in sums.items()]


def _pass(shared, ks: list[int], n: int, dtype: type, update: bool, measure: bool):
    """Updates the activities, unless this is the first pass, and adds up what the weights' update needs.

    Of each key: channels x k sums of ratio times activity, then the k sums of activities.
    """
    tiny = np.finfo(dtype).tiny

    def run(batches):
        weights, sums = shared.value, {}
        for batch in batches:
            rows = []
            for i, r, v, held in _rows_of(batch, n, dtype):
                new = []
                for k, raw in zip(ks, held, strict=True):
                    w = weights.get((k, r))
                    if w is None:
                        new.append(raw.to_pybytes())
                        continue
                    h = np.frombuffer(raw, dtype).reshape(k, -1)
                    if update:
                        h = h * (w.T @ (v / np.maximum(w @ h, tiny))) / np.maximum(w.sum(0)[:, None], tiny)
                    q = np.maximum(w @ h, tiny)
                    _add(sums, (k, r), np.concatenate([(v / q) @ h.T, h.sum(1)[None]]).astype(np.float64), K.kl_loss(v, w, h) if measure else 0.0)
                    new.append(h.astype(dtype).tobytes())
                rows.append(i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([new], pa.list_(pa.binary())), *(pa.nulls(1, f.type) for f in list(_ARROW)[5:])], schema=_ARROW)
        yield pa.RecordBatch.from_pylist(_sum_rows(sums), _ARROW)

    return run


def _collect_sums(state: DataFrame) -> dict[Key, tuple[np.ndarray, float]]:
    """The sums of each key over all tasks; they are as large as the weights."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums").combine_chunks())
        return pa.table({"k": table.column("k").slice(0, 1), "replicate": table.column("replicate").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "loss": [sum(table.column("loss").to_pylist())]})

    rows = state.where("v is null").select("k", "replicate", "sums", "loss").groupBy("k", "replicate").applyInArrow(add, "k int, replicate int, sums binary, loss double")
    return {(r.k, r.replicate): (np.frombuffer(r.sums, np.float64).reshape(-1, r.k), r.loss) for r in rows.collect()}


def factor(held: DataFrame, weights: dict[Key, np.ndarray], ks: list[int], channels: list[str], dtype: type, min_iterations: int, max_iterations: int, test_conv: int, tolerance: float) -> Factors:
    """Multiplicative updates of the generalised divergence, weights first, until a key's loss converges or ``max_iterations``.

    Every ``test_conv`` rounds a key's loss is measured; after more than
    ``min_iterations`` it is done where the loss fell by less than ``tolerance``
    of the first one. Each round's blocks are kept by Spark until the next, and
    every ``WRITE_EVERY`` rounds they are written to the shared folder.
    """
    spark, n = held.sparkSession, len(channels)
    weights = {key: w.astype(dtype) for key, w in weights.items()}
    active, iterations, losses = dict(weights), dict.fromkeys(weights, 0), {}
    state, kept = written(held, "blocks"), []

    def advance(state: DataFrame, update: bool, measure: bool) -> tuple[DataFrame, dict]:
        shared = spark.sparkContext.broadcast(active)
        new = state.where("v is not null").mapInArrow(_pass(shared, ks, n, dtype, update, measure), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(new)
        return new, _collect_sums(new)

    state, sums = advance(state, False, True)
    first = {key: loss for key, (_, loss) in sums.items()}
    last, losses = dict(first), dict(first)
    for i in range(1, max_iterations + 1):
        for key, w in active.items():
            total = sums[key][0]
            active[key] = weights[key] = (w * total[:-1] / np.maximum(total[-1], np.finfo(dtype).tiny)).astype(dtype)
        active = dict(active)
        measure = i % test_conv == 0
        state, sums = advance(state, True, measure)
        if i % WRITE_EVERY == 0:
            state = written(state.where("v is not null"), "blocks")
        while len(kept) > (0 if i % WRITE_EVERY == 0 else 1):
            kept.pop(0).unpersist()
        if measure:
            for key in [*active]:
                losses[key] = sums[key][1]
                if i > min_iterations and (last[key] - losses[key]) / first[key] < tolerance:
                    iterations[key] = i
                    del active[key]
                else:
                    last[key] = losses[key]
        if not active:
            break
    out = written(state.where("v is not null"), "blocks")
    for df in kept:
        df.unpersist()
    return Factors(ks, channels, dtype, weights, iterations, losses, out)


def activities(f: Factors, scale: bool = True) -> DataFrame:
    """(k, replicate, component, sample, activity); ``scale``: for weights that add up to 1, rounded to the samples' totals."""
    shared = f.blocks.sparkSession.sparkContext.broadcast({key: w.sum(0, dtype=np.float64) for key, w in f.weights.items()})
    ks, n, dtype = f.ks, len(f.channels), f.dtype

    def run(batches):
        sizes = shared.value
        for batch in batches:
            for i, r, _, held in _rows_of(batch, n, dtype):
                names, total = batch.column(1).slice(i, 1).flatten(), np.array(batch.column(2)[i].as_py())
                for k, raw in zip(ks, held, strict=True):
                    h = np.frombuffer(raw, dtype).reshape(k, -1).astype(np.float64)
                    if scale:
                        h = h * np.maximum(sizes[k, r], 1e-300)[:, None]
                        h = np.round(h / np.maximum(h.sum(0), 1e-300) * total)
                    for c in range(k):
                        size = len(total)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, x, np.int32)) for x in (k, r, c)] + [names, pa.array(h[c])], ["k", "replicate", "component", "sample", "activity"])

    return f.blocks.mapInArrow(run, "k int, replicate int, component int, sample string, activity double")


def weights_table(spark: SparkSession, f: Factors) -> DataFrame:
    """(k, replicate, w, iterations): each component's weights, adding up to 1."""
    rows = [(k, r, (w / np.maximum(w.sum(0), 1e-300)).T.astype(float).tolist(), f.iterations[k, r]) for (k, r), w in sorted(f.weights.items())]
    return spark.createDataFrame(rows, "k int, replicate int, w array<array<double>>, iterations int")


def metrics(f: Factors) -> DataFrame:
    """(k, replicate, metrics): means over samples of l1, l1 %, l2, l2 %, KL, correlation against what was factored."""
    shared = f.blocks.sparkSession.sparkContext.broadcast(f.weights)
    ks, n, dtype = f.ks, len(f.channels), f.dtype

    def run(batches):
        for batch in batches:
            for _, r, v, held in _rows_of(batch, n, dtype):
                v = v.astype(np.float64)
                for k, raw in zip(ks, held, strict=True):
                    h = np.frombuffer(raw, dtype).reshape(k, -1).astype(np.float64)
                    m = K.similarities(v, shared.value[k, r].astype(np.float64) @ h) * v.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([r], pa.int32()), pa.array([v.shape[1]], pa.int64()), pa.array([m.tolist()], pa.list_(pa.float64()))], ["k", "replicate", "n", "m"])

    rows = f.blocks.mapInArrow(run, "k int, replicate int, n long, m array<double>")
    return rows.groupBy("k", "replicate").agg(F.array(*(F.sum(F.col("m")[i]) / F.sum("n") for i in range(6))).alias("metrics"))


# --- starts from singular vectors


def grams(held: DataFrame, n: int, dtype: type) -> dict[int, np.ndarray]:
    """Channels x channels sums of products over samples, by replicate; as large as the channels' square, not the samples."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for _, r, v, _ in _rows_of(batch, n, dtype):
                v = v.astype(np.float64)
                _add(sums, (n, r), v @ v.T, float(v.sum()))
        yield pa.RecordBatch.from_pylist(_sum_rows(sums), _ARROW)

    found = _collect_sums(held.mapInArrow(run, _STATE))
    return {r: total for (_, r), (total, _) in found.items()}


def singular(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k left singular vectors (signs fixed) and singular values of what the Gram matrix is of."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    u = vectors[:, order]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)
    return u, np.sqrt(np.maximum(values[order], 0))


def singular_starts(held: DataFrame, ks: list[int], channels: list[str], dtype: type, how: str, seed: int) -> tuple[DataFrame, dict[Key, np.ndarray]]:
    """Non-negative starts from the singular vectors of each replicate's counts: blocks with their activities, and weights.

    Two passes beside the one of the Gram matrix: squares of the right vectors'
    positive and negative parts, then the activities. ``how`` as for the kernel:
    zeros stay, or become the mean, small random values, or at least the least count.
    """
    fills = {"nndsvd": "", "nndsvda": "a", "nndsvdar": "ar", "nndsvd_min": "min"}
    if how not in fills:
        raise ValueError(f"unknown start {how!r}")
    fill, n, top = fills[how], len(channels), max(ks)
    vectors = {r: singular(g, min(top, n)) for r, g in grams(held, n, dtype).items()}
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def right(u, s, v):
        return np.where(s[:, None] > 1e-12 * max(s[0], 1e-300), u.T @ v / np.maximum(s, 1e-300)[:, None], 0.0)

    def parts(batches):
        sums: dict = {}
        for batch in batches:
            for _, r, v, _ in _rows_of(batch, n, dtype):
                u, s = shared.value[r]
                t = right(u, s, v.astype(np.float64))
                least = v[v > 0].min() if (v > 0).any() else np.inf
                squares = np.stack([(np.maximum(t, 0) ** 2).sum(1), (np.minimum(t, 0) ** 2).sum(1)])
                _add(sums, (len(s), r), np.concatenate([squares, np.full((1, len(s)), [float(v.sum())]), np.full((1, len(s)), [v.shape[1]])]), 0.0)
                sums[len(s), r].append(least)
        rows = _sum_rows({key: x[:2] for key, x in sums.items()})
        for row, x in zip(rows, sums.values(), strict=True):
            row["total"] = [float(min(x[2:]))]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    measured = written(held.mapInArrow(parts, _STATE), "parts")
    found = _collect_sums(measured)
    least = {x.replicate: x.least for x in measured.groupBy("replicate").agg(F.min(F.col("total")[0]).alias("least")).collect()}
    plans, starts = {}, {}
    for (_, r), (total, _) in found.items():
        u, s = vectors[r]
        mean = total[2, 0] / max(total[3, 0] * n, 1)
        sides = []
        for i in range(len(s)):
            plus, minus = np.maximum(u[:, i], 0), np.maximum(-u[:, i], 0)
            size = [np.linalg.norm(plus) * np.sqrt(total[0, i]), np.linalg.norm(minus) * np.sqrt(total[1, i])]
            side = 0 if i == 0 else int(size[1] > size[0])
            of_w = np.abs(u[:, 0]) if i == 0 else (plus, minus)[side]
            scale = np.sqrt(s[i]) if i == 0 else np.sqrt(s[i] * size[side]) / max(np.sqrt(total[side, i]), 1e-300)
            w = np.sqrt(s[i]) * of_w if i == 0 else np.sqrt(s[i] * size[side]) * of_w / max(np.linalg.norm(of_w), 1e-300)
            sides.append((1 - 2 * side, scale, w))
        plans[r] = ([x[0] for x in sides], np.array([x[1] for x in sides]), mean, least[r])
        for k in ks:
            w = np.zeros((n, k))
            for i in range(min(k, len(s))):
                w[:, i] = sides[i][2]
            starts[k, r] = _filled(w, fill, mean, least[r], generator(seed, 1, k, r))
    told = spark.sparkContext.broadcast(plans)

    def begin(batches):
        for batch in batches:
            for i, r, v, _ in _rows_of(batch, n, dtype):
                u, s = shared.value[r]
                signs, scale, mean, lowest = told.value[r]
                t = right(u, s, v.astype(np.float64))
                h = np.concatenate([np.abs(t[:1]), np.maximum(t[1:] * np.array(signs[1:])[:, None], 0)]) * scale[:, None]
                names, new = batch.column(1)[i].as_py(), []
                for k in ks:
                    own = np.zeros((k, v.shape[1]))
                    own[: min(k, len(s))] = h[:k]
                    noise = np.stack([of_sample(seed + k, r, x).random(k) for x in names], 1) if fill in ("ar", "min") else None
                    new.append(_filled(own, fill, mean, lowest, noise).astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([new], pa.list_(pa.binary())), *(pa.nulls(1, f.type) for f in list(_ARROW)[5:])], schema=_ARROW)

    return held.mapInArrow(begin, _STATE), starts


def _filled(m: np.ndarray, fill: str, mean: float, least: float, noise) -> np.ndarray:
    zero = m < 1e-11
    if fill == "a":
        m = np.where(zero, mean, m)
    elif fill in ("ar", "min"):
        noise = noise.random(m.shape) if isinstance(noise, np.random.Generator) else noise
        m = np.where(zero, noise * mean / 100, m)
    return np.maximum(m, least) if fill == "min" else m
