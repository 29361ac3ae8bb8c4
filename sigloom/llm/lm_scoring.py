"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Events are units: the most frequent tokens, each one of its own, and for all
other tokens the class of their last two bytes. The vector that the last few
units predict is a sum of one matrix product each; its products with the units'
vectors, normalised over all units, are log-probabilities. A token of a class
has the class's probability times its share there, ``(c + 1) / (N + V + 1)``
over the training tokens of the class, so unseen tokens have a share, too.

Token counts cover all training texts and are one grouped sum. The model starts
from a bounded sample on the driver; then every task goes on from there over
every window of the training texts that it reads, and the tasks' parameters are
averaged, weighted by windows. In scoring, frequent tokens are looked up in a
bounded table and each rare one meets its count in one join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .text import SPACED, Words, chunks

#: Units: so many tokens, so many classes of the rest; size of a vector; units before a token that predict it.
TOKENS, CLASSES, DIM, ORDER = 96, 416, 16, 3
#: Tokens whose counts every task holds (16 bytes each); the others' counts are joined.
KNOWN = 1 << 18
#: The starting sample: documents and windows; passes over it.
SAMPLE_DOCS, SAMPLE_WINDOWS, PASSES = 4000, 400_000, 3
#: Windows of one step and noise units that they share; the step's rate.
BATCH, NOISE, RATE = 512, 64, 0.08
#: The token after each text's last word.
END = 1
_U = np.uint64


def classes(words: Words) -> np.ndarray:
    """A class by the last two bytes of each word, case folded."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    fold = np.arange(256)
    fold[65:91] += 32
    last = fold[words.data[words.end - 1]]
    before = np.where(words.end - words.start > 1, fold[words.data[np.maximum(words.end - 2, 0)]], 0)
    return ((last * 256 + before) * 2654435761 % (1 << 32) >> 8) % CLASSES


def with_ends(words: Words, values: np.ndarray, end) -> np.ndarray:
    """``values`` of the words with ``end`` after each text."""
    return np.insert(values, words.ptr[1:], end)


@dataclass
class Model:
    """Units' vectors as context and as target, matrices by distance, biases; counts of frequent tokens and of classes."""

    context: np.ndarray
    matrices: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    class_tokens: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    class_types: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    noise: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: int = 0
    types: int = 0
    #: Windows that the tasks trained on.
    trained: int = 0

    @staticmethod
    def new(hashes: np.ndarray, counts: np.ndarray, of_class: np.ndarray, tokens: np.ndarray, types: np.ndarray, total: int, distinct: int, seed: int = 11) -> Model:
        """Untrained: ``hashes``, ``counts`` and classes of the known tokens; tokens and types of each class in the whole corpus."""
        if not (hashes == _U(END)).any():
            hashes, counts, of_class = np.append(hashes, _U(END)), np.append(counts, 0), np.append(of_class, 0)
            types = types + (np.arange(CLASSES) == 0)
        order = np.lexsort((hashes, -counts))[:TOKENS]
        if not (hashes[order] == _U(END)).any():
            order[-1] = np.flatnonzero(hashes == _U(END))[0]
        tokens = tokens - np.bincount(of_class[order], counts[order], CLASSES).astype(np.int64)
        types = types - np.bincount(of_class[order], minlength=CLASSES)
        rng, size = np.random.default_rng(seed), TOKENS + CLASSES
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        mass = np.concatenate([counts[order] + 1.0, np.zeros(TOKENS - len(order)), tokens + 1.0])
        bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / mass.sum()), -50).astype(np.float32)
        matrices = np.stack([np.eye(DIM, dtype=np.float32) / (j + 1) for j in range(ORDER)]) + draw(0.1, ORDER, DIM, DIM)
        by_hash = np.argsort(hashes)
        unit = np.full(len(hashes), -1, np.int64)
        unit[order] = np.arange(len(order))
        return Model(draw(0.3, size, DIM), matrices, draw(0.1, size, DIM), bias, hashes[by_hash], counts[by_hash], unit[by_hash], tokens, types, mass / mass.sum(), total, distinct)

    @property
    def end(self) -> int:
        return int(self.units[np.searchsorted(self.hashes, _U(END))])

    def look_up(self, hashes: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit and count of each token; count -1 where it is not among the known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        unit = np.where(known, self.units[at], -1)
        return np.where(unit < 0, TOKENS + of_class, unit), np.where(known, self.counts[at], -1)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.matrices, self.target, self.bias]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The vector predicted from units at distance 1, 2, ... (a column each)."""
        out = np.zeros((len(before), DIM), np.float32)
        for j in range(ORDER):
            out += (self.context @ self.matrices[j])[before[:, j]]
        return out

    def log_probabilities(self, before: np.ndarray, unit: np.ndarray, block: int = 512, slab: int = 1 << 16) -> np.ndarray:
        """Natural logarithm of each unit's normalised probability after the units before it."""
        if len(unit) > slab:
            return np.concatenate([self.log_probabilities(before[a : a + slab], unit[a : a + slab], block) for a in range(0, len(unit), slab)])
        rows = self.predicted(before)
        out, ones = np.zeros(len(unit)), np.ones(len(self.bias), np.float32)
        steep = np.sqrt((rows**2).sum(1).max(initial=0) * (self.target**2).sum(1).max()) + np.abs(self.bias).max() > 60
        for a in range(0, len(unit), block):
            b = min(a + block, len(unit))
            logits = rows[a:b] @ self.target.T
            logits += self.bias
            own = logits[np.arange(b - a), unit[a:b]].astype(np.float64)
            top = logits.max(1, keepdims=True) if steep else 0
            if steep:
                logits -= top
            np.exp(logits, out=logits)
            out[a:b] = own - np.ravel(top) - np.log((logits @ ones).astype(np.float64))
        return out


def windows(unit: np.ndarray, place: np.ndarray, end: int) -> np.ndarray:
    """The units at distance 1 to ORDER before each; before a text's first stands ``end``."""
    out = np.full((len(unit), ORDER), end, np.int32)
    for j in range(ORDER):
        out[j + 1 :, j] = unit[: len(unit) - j - 1]
        out[place <= j, j] = end
    return out


def places(words: Words) -> np.ndarray:
    """Place within its text of each token, ends included."""
    sizes = np.diff(words.ptr) + 1
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Trainer:
    """Noise-contrastive steps by Adagrad: each window's unit against noise units that the step's windows share."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.sums = [np.full(p.shape, 1e-3, np.float32) for p in model.parameters()]
        self.log_noise = np.log(np.maximum(NOISE * model.noise, 1e-30)).astype(np.float32)
        self.cumulative = np.cumsum(model.noise)

    def _add(self, k: int, grad: np.ndarray) -> None:
        """A step of parameter k; where the gradient is 0 nothing moves."""
        p, s = self.m.parameters()[k], self.sums[k]
        grad = grad.astype(np.float32)
        s += grad * grad
        p -= RATE * grad / np.sqrt(s)

    def _by_unit(self, unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sum of the rows of each unit."""
        size = len(self.m.bias)
        return np.bincount((unit[:, None] * DIM + np.arange(DIM)).ravel(), rows.ravel(), size * DIM).reshape(size, DIM)

    def step(self, before: np.ndarray, unit: np.ndarray) -> None:
        m, n = self.m, len(unit)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), len(m.bias) - 1)
        h, against, level = m.predicted(before), m.target[noise], m.bias - self.log_noise
        own = np.einsum("ij,ij->i", h, m.target[unit]) + level[unit]
        other = h @ against.T + level[noise]
        g_own = ((1 / (1 + np.exp(-own)) - 1) / n).astype(np.float32)
        g_other = (1 / (1 + np.exp(-other)) / n).astype(np.float32)
        d_h = g_own[:, None] * m.target[unit] + g_other @ against
        sums = [self._by_unit(before[:, j], d_h) for j in range(ORDER)]
        d_context = sum(s @ m.matrices[j].T for j, s in enumerate(sums))
        d_matrices = np.stack([m.context.T @ s for s in sums])
        d_target = self._by_unit(unit, g_own[:, None] * h)
        np.add.at(d_target, noise, g_other.T @ h)
        d_bias = np.bincount(unit, g_own, len(m.bias)) + np.bincount(noise, g_other.sum(0), len(m.bias))
        for k, grad in enumerate((d_context, d_matrices, d_target, d_bias)):
            self._add(k, grad)

    def run(self, before: np.ndarray, unit: np.ndarray, passes: int = 1) -> None:
        for _ in range(passes):
            order = self.rng.permutation(len(unit))
            for a in range(0, len(unit), BATCH):
                self.step(before[order[a : a + BATCH]], unit[order[a : a + BATCH]])


def _counter(text_at: int = 0):
    """(hash, class, n) of the tokens of a task's texts, merged as they come."""

    def merged(parts):
        hashes, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return hashes, np.concatenate([p[1] for p in parts])[first], np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)

    def batch_of(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["hash", "class", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, words in chunks(batch.column(text_at), SPACED):
                hashes, first, n = np.unique(with_ends(words, words.hash, _U(END)), return_index=True, return_counts=True)
                held.append((hashes, with_ends(words, classes(words), 0)[first], n))
                size += len(hashes)
                if size > 1 << 20:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield batch_of(held.pop())
                        size = 0
        if held:
            yield batch_of(merged(held))

    return run


def _picked(model: Model, words: Words, share: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a random share of all tokens of a chunk: the units before, and the unit."""
    place = places(words)
    at = np.flatnonzero(rng.random(len(place)) < share)
    hashes, of_class = with_ends(words, words.hash, _U(END)), with_ends(words, classes(words), 0)
    unit = model.look_up(hashes[at], of_class[at])[0]
    before = np.full((len(at), ORDER), model.end, np.int32)
    for j in range(ORDER):
        inside = place[at] > j
        prior = at[inside] - j - 1
        before[inside, j] = model.look_up(hashes[prior], of_class[prior])[0]
    return before, unit


def _sampler(shared, share: float):
    def run(batches):
        rng = np.random.default_rng((5, TaskContext.get().partitionId()))
        for batch in batches:
            for _, _, words in chunks(batch.column(0), SPACED):
                before, unit = _picked(shared.value, words, share, rng)
                packed = np.concatenate([before, unit[:, None]], 1).astype(np.int16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["windows"])

    return run


def _refiner(shared):
    """A task's own parameters after steps over all its windows, times their number; and that number."""

    def run(batches):
        model, n = shared.value, 0
        model = Model(**{**model.__dict__, **{k: getattr(model, k).copy() for k in ("context", "matrices", "target", "bias")}})
        trainer = Trainer(model, TaskContext.get().partitionId())
        for batch in batches:
            for _, _, words in chunks(batch.column(0), SPACED):
                unit = model.look_up(with_ends(words, words.hash, _U(END)), with_ends(words, classes(words), 0))[0]
                trainer.run(windows(unit, places(words), model.end), unit)
                n += len(unit)
        if n:
            flat = np.concatenate([p.ravel() for p in model.parameters()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))], ["at", "value", "n"])

    return run


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, class, n) of every token of all texts, ends included, written; a null text is empty."""
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(), "hash long, class int, n long")
    return materialise(found.groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "tokens")


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """A model trained on ``docs``, and the counts of their tokens.

    Every token of every text is counted and is the last of one window that is
    trained on; ``SAMPLE_DOCS`` and ``SAMPLE_WINDOWS`` bound only what the
    parameters that the tasks start from are fitted on. Without rows the model
    gives every unit its starting probability.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = count_tokens(docs, text_col)
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    known = counts.orderBy(F.desc("n"), "hash").limit(KNOWN).toArrow()
    sums = {r["class"]: r for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    of = lambda name: np.array([sums[c][name] if c in sums else 0 for c in range(CLASSES)], np.int64)
    hashes, of_class, n = (known.column(c).to_numpy() for c in ("hash", "class", "n"))
    model = Model.new(hashes.astype(_U), n.astype(np.int64), of_class.astype(np.int64), of("n"), of("types"), total, distinct)
    if not total:
        return model, counts
    texts_n = int(model.counts[np.searchsorted(model.hashes, _U(END))])
    share = min(1.0, SAMPLE_DOCS / max(1, texts_n))
    shared = spark.sparkContext.broadcast(model)
    packed = texts.sample(share, 3).mapInArrow(_sampler(shared, min(1.0, SAMPLE_WINDOWS / (total * share))), "windows binary").collect()
    rows = np.frombuffer(b"".join(r.windows for r in packed), np.int16).reshape(-1, ORDER + 1).astype(np.int32)
    Trainer(model, 7).run(rows[:, :ORDER], rows[:, ORDER], PASSES)
    shared = spark.sparkContext.broadcast(model)
    sent = texts.mapInArrow(_refiner(shared), "at int, value double, n long")
    mean = sent.groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value"), F.sum("n").alias("n")).toArrow()
    if mean.num_rows:
        model.trained = mean.column("n")[0].as_py()
        flat = np.zeros(mean.num_rows)
        flat[mean.column("at").to_numpy()] = mean.column("value").to_numpy()
        for p in model.parameters():
            p[...] = flat[: p.size].reshape(p.shape)
            flat = flat[p.size :]
    return model, counts


def _scorer(shared, text_at: int):
    def run(batches):
        model, task, row = shared.value, TaskContext.get().partitionId(), 0
        slot = np.log10(model.total + model.types + 1)
        class_slot = np.log10(model.class_tokens + model.class_types + 1)
        for batch in batches:
            for a, b, words in chunks(batch.column(text_at), SPACED):
                hashes, of_class = with_ends(words, words.hash, _U(END)), with_ends(words, classes(words), 0)
                unit, count = model.look_up(hashes, of_class)
                first = np.concatenate([[0], np.cumsum(np.diff(words.ptr) + 1)[:-1]])
                own = np.log10(np.maximum(count, 0) + 1)
                share = np.where(unit < TOKENS, 0, own - class_slot[of_class])
                log_p = model.log_probabilities(windows(unit, places(words), model.end), unit) / np.log(10)
                add = lambda x: np.add.reduceat(x, first)  # noqa: B023,E731
                sizes, rare = np.diff(words.ptr) + 1, count < 0
                offsets = np.concatenate([[0], np.cumsum(add(rare.astype(np.int64)))]).astype(np.int32)
                out = [
                    pa.array((task << 33) + row + np.arange(b - a)), pa.array(sizes), pa.array(add((count > 0).astype(np.int64))), pa.array(add(own) - sizes * slot), pa.array(add(log_p + share)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[rare].astype(np.int64)))]
                row += b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], ["row", "at", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_tokens, n_known, base_score and score; ``model`` and ``counts`` as :func:`fit` gives them.

    ``score`` is the log10 probability of a text and its end; ``base_score``
    that of its tokens one by one, ``(c + 1) / (N + V + 1)`` each; ``n_known``
    counts the tokens with c > 0. A null text is empty: its end alone is scored.
    Repeated rows and null ids are rows like others, no rows give no rows, and a
    column of ``docs`` named like a result is left out. Tokens are told apart by
    a 64-bit hash.
    """
    made = ["n_tokens", "n_known", "base_score", "score"]
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c not in made)).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scorer(shared, 1), f"row {kind}, at long, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    scored = materialise(scored, "scored")
    least = int(model.counts.min())
    rare = scored.select("at", F.explode("rare").alias("hash")).join(counts.where(F.col("n") <= least).select("hash", "n"), "hash")
    more = rare.groupBy("at").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("found"))
    joined = scored.drop("rare").join(more, "at", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return joined.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in made), "n_tokens", (F.col("n_known") + found).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
