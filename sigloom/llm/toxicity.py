"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first
4, 5 and 6 bytes, so inflected forms share weights. Filters of several widths
slide over the words, each is max-pooled over the whole text, and a logistic
layer gives the score. Training uses a bounded sample of labelled rows on the
driver; scoring runs in the tasks on every row's whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, small_batches
from .text import ALNUM, Words, beginnings, chunks

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
STARTS = (4, 5, 6)
#: The training sample: rows of each label, and words in all.
SAMPLE_ROWS, SAMPLE_WORDS = {1: 3000, 0: 6000}, 4_000_000
_PAD = max(WIDTHS) - 1
#: Log odds of a model that saw no toxic row.
NEVER = -20.0


def buckets(words: Words) -> np.ndarray:
    """Words x 4 bucket numbers."""
    cols = [words.hash, *beginnings(words, ALNUM, STARTS)]
    return np.stack([(c >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1) for c in cols], 1).astype(np.uint16)


def _padded(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words among the rows of a padded sequence, each text's first row, and the number of rows.

    A text has ``1 + _PAD`` empty rows after its words; a filter starts at its words or the first of these, so none sees two texts.
    """
    counts = np.diff(ptr)
    first = ptr[:-1] + np.arange(len(counts)) * (1 + _PAD)
    at = np.arange(len(ids)) + np.repeat(first - ptr[:-1], counts)
    return at, first, counts


@dataclass
class Model:
    emb: np.ndarray
    conv: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @staticmethod
    def new(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        u = lambda *shape, s: rng.uniform(-s, s, shape).astype(np.float32)
        return Model(u(BUCKETS, DIM, s=0.05), [[u(DIM, FILTERS, s=0.4) for _ in range(w)] for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), u(FILTERS * len(WIDTHS), s=0.4), 0.0)

    def forward(self, ids: np.ndarray, ptr: np.ndarray):
        at, first, counts = _padded(ids, ptr)
        n = len(ids) + len(counts) * (1 + _PAD)
        x = np.zeros((n + _PAD, DIM), np.float32)
        total = self.emb[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            total += self.emb[ids[:, j]]
        x[at] = total
        maps = np.concatenate([sum(x[j : n + j] @ m for j, m in enumerate(ms)) for ms in self.conv], 1)
        for j in range(_PAD):  # from here a filter would see the next text
            maps[first + counts + 1 + j] = -np.inf
        pooled = np.maximum(np.maximum.reduceat(maps, first, 0) + self.bias, 0) if len(first) else np.zeros((0, len(self.bias)), np.float32)
        return x, maps, at, first, pooled, pooled @ self.out + np.float32(self.out_bias)

    def score(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(ids, ptr)[-1].astype(np.float64)))


def train(ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 700, batch: int = 24, rate: float = 0.02, seed: int = 7) -> Model:
    """Weighted logistic loss by Adam; embeddings take sparse steps."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    groups = [np.flatnonzero(y == c) for c in (0, 1)]
    if not y.any():
        model.out[:], model.out_bias, model.threshold = 0, NEVER, np.inf
        return model
    dense = [m for ms in model.conv for m in ms]
    moments = [np.zeros_like(m) for m in dense], [np.zeros_like(m) for m in dense]
    vec = [[np.zeros_like(model.bias)] * 2, [np.zeros_like(model.out)] * 2, [np.zeros(1, np.float32)] * 2]
    e1, e2 = np.zeros_like(model.emb), np.zeros_like(model.emb)
    for step in range(1, steps + 1):
        pick = rng.choice(len(y), min(batch, len(y)), replace=False)
        if all(len(g) for g in groups):
            pick[: len(pick) // 3] = rng.choice(groups[1], len(pick) // 3)
            pick[len(pick) // 3 :] = rng.choice(groups[0], len(pick) - len(pick) // 3)
        docs = [ids[i] for i in pick]
        ptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        flat = np.concatenate(docs)
        x, maps, at, first, pooled, z = model.forward(flat, ptr)
        p = 1 / (1 + np.exp(-z))
        g = ((p - y[pick]) * weight[pick] / weight[pick].sum()).astype(np.float32)
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)

        def adam(a, m, v, grad):
            m[...] = 0.9 * m + 0.1 * grad
            v[...] = 0.999 * v + 0.001 * grad * grad
            a -= lr * fix * m / (np.sqrt(v) + 1e-7)  # noqa: B023

        d_pool = g[:, None] * model.out * (pooled > 0)
        ends = np.append(first[1:], len(maps))
        top = np.stack([a + maps[a:b].argmax(0) for a, b in zip(first, ends, strict=True)])
        d_x, d_conv, k = np.zeros_like(x), [], 0
        for c, ms in enumerate(model.conv):
            cols = slice(c * FILTERS, (c + 1) * FILTERS)
            for j, m in enumerate(ms):
                rows, d = (top[:, cols] + j).ravel(), d_pool[:, cols].ravel()
                flt = np.tile(np.arange(FILTERS), len(pick))
                d_m = np.zeros_like(m.T)
                np.add.at(d_m, flt, d[:, None] * x[rows])
                np.add.at(d_x, rows, d[:, None] * m.T[flt])
                d_conv.append(d_m.T)
        d_out, d_bias, d_ob = g @ pooled, d_pool.sum(0), np.array([g.sum()])
        for k, m in enumerate(dense):
            adam(m, moments[0][k], moments[1][k], d_conv[k])
        for n, (a, grad) in enumerate(((model.bias, d_bias), (model.out, d_out))):
            vec[n] = [v.copy() for v in vec[n]] if step == 1 else vec[n]
            adam(a, vec[n][0], vec[n][1], grad)
        vec[2] = [v.copy() for v in vec[2]] if step == 1 else vec[2]
        ob = np.array([model.out_bias], np.float32)
        adam(ob, vec[2][0], vec[2][1], d_ob)
        model.out_bias = float(ob[0])
        dw = d_x[at]
        hit = np.flatnonzero(np.abs(dw).sum(1))
        if len(hit):
            where, inv = np.unique(flat[hit].ravel(), return_inverse=True)
            grad = np.zeros((len(where), DIM), np.float32)
            np.add.at(grad, inv.ravel(), np.repeat(dw[hit], flat.shape[1], 0))
            e1[where] = 0.9 * e1[where] + 0.1 * grad
            e2[where] = 0.999 * e2[where] + 0.001 * grad * grad
            model.emb[where] -= lr * fix * e1[where] / (np.sqrt(e2[where]) + 1e-7)
    return model


def calibrate(score: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: float = 1.0) -> float:
    """The threshold of the best weighted F score; halfway to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, hit, w = score[order], y[order] * weight[order], weight[order]
    f = (1 + beta**2) * np.cumsum(hit) / (np.cumsum(w) + beta**2 * max(hit.sum(), 1e-9))
    f[:-1][s[:-1] == s[1:]] = -1
    best = int(np.argmax(f))
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0.0)) / 2)


def _feature_rows(batches):
    for batch in batches:
        for a, b, words in chunks(batch.column(3), ALNUM):
            ids = buckets(words)
            packed = [ids[s:e].tobytes() for s, e in zip(words.ptr[:-1], words.ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(packed, pa.binary())], ["doc_id", "y", "lang", "ids"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", allowed=None, min_positives: int = 20) -> Model:
    """Train on a bounded sample of the labelled rows (``SAMPLE_ROWS`` of each label by hash of the id, ``SAMPLE_WORDS`` words in all).

    ``allowed``: a condition on the label rows that may be used. Weights give
    the sample the label shares of all allowed rows. A sixth of the sample is
    kept from training and sets the threshold of each language (``lang_col``)
    with ``min_positives`` toxic rows there, and one for the rest. Null ids and
    labels other than 0 and 1 are not used. Ids are integers. Without toxic rows every
    score is next to 0 and nothing is rejected.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if allowed is not None:
        marked = marked.where(allowed)
    marked = materialise(marked.groupBy("doc_id").agg(F.max("y").alias("y")), "labelled")
    share = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    rank = F.xxhash64("doc_id", F.lit(5))
    picked = marked.where("y = 1").orderBy(rank, "doc_id").limit(SAMPLE_ROWS[1]).union(marked.where("y = 0").orderBy(rank, "doc_id").limit(SAMPLE_ROWS[0]))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(materialise(picked, "picked"), "doc_id").select("doc_id", "y", "lang", "text")
    rows = rows.mapInArrow(_feature_rows, "doc_id long, y int, lang string, ids binary")
    sample, total = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").toLocalIterator():
        total += len(r.ids) // 8
        if total > SAMPLE_WORDS:
            break
        sample.append((r.doc_id, r.y, r.lang, np.frombuffer(r.ids, np.uint16).reshape(-1, 1 + len(STARTS))))
    y = np.array([s[1] for s in sample], np.int64)
    weight = np.array([share[v] / max(1, (y == v).sum()) for v in y], np.float64)
    aside = np.arange(len(y)) % 6 == 5
    own = np.flatnonzero(~aside)
    model = train([sample[i][3] for i in own], y[own], weight[own])
    if aside.any():
        held = np.flatnonzero(aside)
        score = np.concatenate([model.score(sample[i][3], np.array([0, len(sample[i][3])])) for i in held])
        if y[held].sum():
            model.threshold = calibrate(score, y[held], weight[held])
        langs = np.array([sample[i][2] or "" for i in held])
        for name in set(langs):
            of = langs == name
            if y[held][of].sum() >= min_positives:
                model.thresholds[name] = calibrate(score[of], y[held][of], weight[held][of])
    return model


def _scorer(model, text_at: int, schema_names: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, words in chunks(batch.column(text_at), ALNUM):
                score[a:b] = m.score(buckets(words), words.ptr)
            cols = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in schema_names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], [*(n for n in batch.schema.names if n in schema_names), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.3) -> DataFrame:
    """id_col, score, predicted for every row; null and empty texts get the score of no words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(shared, 1, ["doc_id"]), "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def _filter(model, text_at: int, lang_at: int | None):
    def run(batches):
        m = model.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            bar = np.full(batch.num_rows, m.threshold)
            if lang_at is not None:
                bar = np.array([m.thresholds.get(v, m.threshold) for v in batch.column(lang_at).to_pylist()])
            for a, b, words in chunks(batch.column(text_at), ALNUM):
                keep[a:b] = m.score(buckets(words), words.ptr) < bar[a:b]
            yield batch.filter(pa.array(keep))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold of their language.

    Null and empty texts have the score of no words; a language without a threshold of its own, and a null one, have the
    common one. Repeated rows share one fate; no rows give no rows; columns may have any names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    return docs.mapInArrow(_filter(shared, names.index(text_col), names.index(lang_col) if lang_col else None), docs.schema)
