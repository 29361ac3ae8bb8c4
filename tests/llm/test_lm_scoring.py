"""Language-model scores: exact base figures, a forward pass by hand, gain on held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from sigloom.llm import lm_scoring as L
from sigloom.llm import queries
from sigloom.llm.text import SPACED, chunks


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    count = collections.Counter(t for r in docs if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = {r.doc_id: (held(r.doc_id), len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for r in docs for t in [tokens(r.text)]}
    got = queries.op11_lm_scoring(spark, sf).collect()
    assert len(got) == len(docs) and got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score < 0
    for fold in (True, False):
        rows = [r for r in got if r.held_out == fold]
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.99, fold


def _model(spark, texts):
    return L.fit(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_forward_pass_by_hand_and_normalised(spark, monkeypatch):
    monkeypatch.setattr(L, "KNOWN", 300)
    texts = ["The cat sat on the mat", "the dog sat", "a cat a dog the end", None, ""] * 30 + [f"rare{i} word{i} the cat" for i in range(60)]
    model, counts = _model(spark, texts)
    count = collections.Counter(x for t in texts for x in tokens(t))
    assert model.total == sum(count.values()) and model.types == len(count) == counts.count()
    before = L.windows(np.arange(5, dtype=np.int64), np.arange(5), model.end)
    every = [model.log_probabilities(np.repeat(before[i : i + 1], len(model.bias), 0), np.arange(len(model.bias))) for i in range(5)]
    assert np.allclose([np.exp(e).sum() for e in every], 1, atol=1e-5)
    known = dict(zip(model.hashes.tolist(), zip(model.units.tolist(), model.counts.tolist(), strict=True), strict=True))
    for t in ["The cat sat", "a never-seen word rare7", None]:
        got = L.score(spark.createDataFrame([(1, t, 0)], "id long, text string, score int"), model, counts).first()
        assert got.__fields__ == ["id", "text", "n_tokens", "n_known", "base_score", "score"]
        ((_, _, words),) = chunks(__import__("pyarrow").array([t], "string"), SPACED)
        h, c = [*words.hash.tolist(), L.END], [*L.classes(words).tolist(), 0]
        units = [known[x][0] if x in known and known[x][0] >= 0 else L.TOKENS + k for x, k in zip(h, c, strict=True)]
        total = 0.0
        for i, u in enumerate(units):
            q = sum(model.context[units[i - j - 1] if i > j else model.end].astype(float) @ model.matrices[j].astype(float) for j in range(L.ORDER))
            logits = model.target.astype(float) @ q + model.bias
            total += (logits[u] - np.log(np.exp(logits).sum())) / np.log(10)
            if u >= L.TOKENS:
                total += math.log10((count[tokens(t)[i]] + 1) / (model.class_tokens[c[i]] + model.class_types[c[i]] + 1))
        assert got.score == pytest.approx(total, abs=1e-4)
    shares = collections.Counter()
    for r in counts.collect():
        u = known.get(r.hash % (1 << 64), (-1, 0))[0]
        if u < 0:
            shares[r["class"]] += r.n + 1
    assert all(shares[c] == model.class_tokens[c] + model.class_types[c] for c in range(L.CLASSES))


def test_cases(spark):
    """No training rows, no rows, repeated rows, null ids, very long texts, clashing names."""
    none = spark.createDataFrame([], "id long, text string")
    model, counts = L.fit(none)
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "Word " * 300_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = L.score(df, model, counts).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 300_001] and all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    model, counts = L.fit(df)
    got = {(r.id, r.text and r.text[:3]): r for r in L.score(df.withColumn("n_known", df.id), model, counts).collect()}
    n, v = 300_001 + 3 + 3, 4
    assert model.total == n and model.types == v
    assert got[3, "Wor"].n_known == 300_001 and got[3, "Wor"].base_score == pytest.approx(300_000 * math.log10(300_001 / (n + v + 1)) + math.log10(6 / (n + v + 1)))
    assert L.score(none, model, counts).count() == 0


def test_every_window_is_trained_on(spark, monkeypatch):
    """What a token follows counts at each of its places, and at those alone that the starting sample lacks."""
    monkeypatch.setattr(L, "SAMPLE_WINDOWS", 1)
    texts = ["a b c d e", None, "", "x", "long text " * 20_000, *(f"w{i} v{i} a" for i in range(3000))]
    model, _ = _model(spark, texts)
    assert model.trained == model.total == sum(len(tokens(t)) for t in texts)
    before = np.array([[0] * L.ORDER] * 40 + [[1] * L.ORDER] * 24)
    trainer, unit = L.Trainer(model, 1), np.repeat([2, 3, 4], [40, 12, 12])
    rows = np.random.default_rng(2).normal(size=(64, L.DIM))
    want = np.zeros((len(model.bias), L.DIM))
    np.add.at(want, unit, rows)
    assert np.allclose(trainer._by_unit(unit, rows), want)
    for _ in range(300):
        trainer.step(before, unit)
    p = np.exp(model.log_probabilities(before[[0, -1]], np.array([2, 3])))
    assert p[0] > 0.8 and p[1] > 0.3
