"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits its vectors again and again at the median along a random
direction; the share of vectors nearest to a split spills to both sides. That
share follows from the depth that the table needs, so that a tree makes a bounded
number of places for a vector and its leaves keep their size at any size of table.
The splits are fitted on a bounded sample. Trees are added until pairs at the
wanted cosine, made from the sample, meet often enough: more of them for a deeper
tree. Every vector is then routed in the tasks, vectors are compared within leaves
only, in blocks of bounded size, and links are united.

A pair that meets in several leaves is counted in the first of them, so link
counts need no list of all pairs.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import materialise, small_batches

#: Share of pairs at the wanted cosine that must meet in a leaf, so many of which are tried; trees at most.
RECALL, TRIED, TREES = 0.97, 1000, 48
#: Vectors that fit the splits.
SAMPLE = 40_000
#: Rows aimed at in a leaf, rows of the sample needed for a split, rows compared at once.
LEAF, LEAST, BLOCK = 1000, 6, 2000
#: A tree's places for each vector, in the mean.
COPIES = 3.0
#: A node whose spread along the direction is under so many times that of the difference of a pair at the wanted cosine is not split.
TIGHT = 1.5


@dataclass
class Tree:
    """Inner node n has children 2n + 1 and 2n + 2 in ``child``; a leaf's children are -1."""

    direction: np.ndarray
    at: np.ndarray
    wide: np.ndarray
    child: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, scale: float, seed: int, cosine: float = 0.93) -> Tree:
        """``x``: unit vectors, each of which stands for ``scale`` ones."""
        rng, dim = np.random.default_rng(seed), x.shape[1]
        depth = max(1, int(np.ceil(np.log2(max(len(x) * scale / LEAF, 1.0)))))
        share = COPIES ** (1 / depth) - 1
        apart = np.sqrt(2 * (1 - cosine) / dim)
        direction, at, wide, child, todo = [np.zeros(dim)], [0.0], [0.0], [[-1, -1]], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) * scale <= LEAF or len(rows) < LEAST:
                continue
            d = rng.standard_normal(dim)
            d /= np.linalg.norm(d)
            p = x[rows] @ d
            middle = float(np.median(p))
            if p.std() < TIGHT * apart:
                continue  # a tight group: splits would part what belongs together; it is compared whole, in blocks
            spill = float(np.quantile(np.abs(p - middle), share))
            direction[node], at[node], wide[node] = d, middle, spill
            for side, rows_ in enumerate((rows[p < middle + spill], rows[p >= middle - spill])):
                child[node][side] = len(at)
                direction.append(np.zeros(dim))
                at.append(0.0)
                wide.append(0.0)
                child.append([-1, -1])
                todo.append((child[node][side], rows_))
        return Tree(np.array(direction), np.array(at), np.array(wide), np.array(child))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each place a row comes to."""
        row, node, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(row):
            leaf = self.child[node, 0] < 0
            done.append((row[leaf], node[leaf]))
            row, node = row[~leaf], node[~leaf]
            p = np.einsum("ij,ij->i", x[row], self.direction[node]) - self.at[node]
            low, high = p < self.wide[node], p >= -self.wide[node]
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.child[node[low], 0], self.child[node[high], 1]])
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the greatest component is divided out first, so that no square under- or overflows."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(x: np.ndarray, scale: float, cosine: float) -> tuple[list[Tree], float]:
    """Trees over a sample of unit vectors, and the share of pairs at exactly ``cosine`` that meet in them.

    The pairs are vectors of the sample and others made from them, which the splits have not seen.
    """
    rng = np.random.default_rng(19)
    a = x[rng.permutation(len(x))[:TRIED]]
    side = rng.standard_normal(a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a) if x.shape[1] > 1 else np.zeros_like(a)
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * side
    trees, met = [], np.zeros(len(a), bool)
    while len(trees) < TREES:
        trees.append(Tree.fit(x, scale, len(trees), cosine))
        (i, p), (j, q) = trees[-1].leaves(a), trees[-1].leaves(b)
        n = len(trees[-1].at)
        met[np.intersect1d(i * n + p, j * n + q) // n] = True
        if met.mean() >= RECALL and (len(trees) > 1 or n == 1):  # one tree that splits may part a group of real vectors that the pairs do not show
            break
    return trees, float(met.mean())


def _router(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = unit(np.asarray(batch.column(3).flatten(), np.float64).reshape(n, -1))
            places = [t.leaves(x) for t in trees]
            row = np.concatenate([p[0] for p in places])
            code = np.concatenate([p[1] + (k << 32) for k, p in enumerate(places)])
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            starts = np.searchsorted(row, np.arange(n + 1))
            codes = [code[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(codes, pa.binary()).take(take)], ["leaf", "label", "id", "copies", "vector", "codes"])

    return run


def _table(codes: list[bytes]) -> np.ndarray:
    """Rows x trees x places, padded with distinct negative numbers that equal nothing."""
    flat = [np.frombuffer(c, np.int64) for c in codes]
    trees = 1 + max(int(f[-1] >> 32) for f in flat)
    width = max(int(np.bincount(f >> 32).max()) for f in flat)
    out = np.full((len(flat), trees, width), -1, np.int64)
    for i, f in enumerate(flat):
        t = f >> 32
        out[i, t, np.arange(len(f)) - np.searchsorted(t, t)] = f
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components of few local vertices: least number reachable over the pairs."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(cosine: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, first, second = int(key[0]), int(key[2]), int(key[3])
        x = unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
        ids, copies, codes = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), _table(pdf["codes"].tolist())
        side = pdf["block"].to_numpy()
        a, b = np.flatnonzero(side == first), np.flatnonzero(side == second)
        links, pairs = np.zeros(len(ids), np.int64), []
        root = np.arange(len(ids))
        for s in range(0, len(a), 256):
            rows = a[s : s + 256]
            i, j = np.nonzero(x[rows] @ x[b].T >= cosine)
            i, j = rows[i], b[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            for q in range(0, len(i), 100_000):
                p, r = i[q : q + 100_000], j[q : q + 100_000]
                c, d = codes[p][:, :, :, None], codes[r][:, :, None, :]
                earlier = ((c == d) & (c >= 0) & (c < leaf)).any((1, 2, 3))
                np.add.at(links, p[~earlier], copies[r[~earlier]])
                np.add.at(links, r[~earlier], copies[p[~earlier]])
                new = root[p] != root[r]
                if new.any():
                    merged = _roots(len(ids), np.concatenate([np.arange(len(ids)), p[new]]), np.concatenate([root, r[new]]))
                    root = merged
        some = np.flatnonzero(links)
        joined = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[joined]]), "b": pd.array([None] * len(some) + ids[root[joined]].tolist(), "Int64"), "n": np.concatenate([links[some], np.zeros(len(joined), np.int64)])})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors of equal, non-null label whose cosine in double precision is at
    least ``cosine`` and that meet in a leaf are linked; component_id is the
    smallest id reachable. Vectors that are null, zero, or hold a null or
    non-finite component, and those of null label, are linked with nothing.
    Equal vectors are one class, linked fully. Vectors of one length meet only
    with their like. Ids are integers; a row of null id is returned without links.
    Other columns may have any name.
    """
    spark = vectors.sparkSession
    small_batches(spark, 5000)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    by = F.concat_ws(":", F.size("vector"), "label")
    told = materialise(rows.select("id", "sound", F.when(F.col("sound"), by).alias("label"), F.when(F.col("sound"), F.col("vector")).alias("vector")), "vectors")
    classes = materialise(told.where("sound").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes").select("label", "id", "copies", "vector")
    found = None
    for (dim,) in classes.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect():
        own = classes.where(F.size("vector") == dim)
        n = own.count()
        picked = own.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
        sample = unit(np.asarray(picked.flatten(), np.float64).reshape(len(picked), -1))
        trees, met = forest(sample, n / len(sample), cosine)
        if met < RECALL:
            logging.getLogger(__name__).warning("%d trees: %.3f of pairs at the wanted cosine meet, %.2f were asked for", len(trees), met, RECALL)
        shared = spark.sparkContext.broadcast(trees)
        routed = materialise(own.mapInArrow(_router(shared), "leaf long, label string, id long, copies long, vector array<double>, codes binary"), "routed")
        sizes = routed.groupBy("leaf", "label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")).where("rows > 1")
        block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        placed = routed.join(sizes, ["leaf", "label"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        out = placed.select("leaf", "label", "first", "second", "block", "id", "copies", "vector", "codes").groupBy("leaf", "label", "first", "second").applyInPandas(_compare(cosine), "a long, b long, n long")
        out = materialise(out, "compared")
        found = out if found is None else found.union(out)
    if found is None:
        linked = told.select("id", "sound", F.lit(0).cast("long").alias("n"), F.col("id").alias("comp"))
    else:
        links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
        comps = components(found.where("b is not null").select("a", "b"))
        of = classes.select("label", "vector", F.col("id").alias("cid"), "copies").join(links, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
        linked = told.join(of, ["label", "vector"], "left").select("id", "sound", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n"), F.coalesce("comp", "cid", "id").alias("comp"))
    return linked.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(False)).alias("kept"))
