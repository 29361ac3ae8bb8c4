"""Periodic runs against a plain scan of all lags."""

import hashlib
import random
import re
import zlib

from sigloom.llm import periodic_runs as P
from sigloom.llm import queries

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(words, least=12, exponent=2):
    """(start, period, length): every maximal stretch of each lag, unless a smaller lag keeps it, too."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    words = planted(doc_id, _WORD.findall((text or "").encode()))
    runs = brute(words)
    best = min(((-length, s, q) for s, q, length in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs).encode()), sha(collapsed(words, runs)))


def test_stretches_equal_brute_force():
    rng = random.Random(5)
    for trial in range(300):
        n, kinds = rng.randrange(0, 90), rng.choice([1, 2, 3, 20])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 12), rng.randrange(0, n + 1)
            words[at : at + p * 4] = words[at : at + p] * 4
        exponent = 2 + trial % 2
        got = P.stretches(P.number(words), 1, len(words), 12, exponent)
        assert [tuple(r) for r in P._by_start(got)] == brute(words, 12, exponent), words
        assert P.collapse(words, P._by_start(got)) == collapsed(words, brute(words, 12, exponent))


def test_cases_and_long_texts(spark):
    """Texts that go by lag ranges and those that don't give what the brute force gives; null, empty and repeated rows, clashing names."""
    rng = random.Random(6)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a " * 40, 0), (4, "a b " * 30, 0), (4, "a b " * 30, 0), (5, text(700, 2), 1), (6, text(300, 50) + " x y z" * 9, 1), (7, " é   " * 13, 1)]
    df = spark.createDataFrame(rows, "id long, text string, runs int")
    want = sorted(((i, [tuple(r) for r in brute(w)], collapsed(w, brute(w)).decode()) for i, t, _ in rows for w in [_WORD.findall((t or "").encode())]), key=repr)
    for long_bytes in (1 << 16, 100, 0):
        got = P.periodic_runs(df, long_bytes=long_bytes)
        assert got.columns == ["id", "text", "runs", "collapsed"]
        assert sorted(((r.id, [tuple(x) for x in r.runs or []], r.collapsed) for r in got.collect()), key=repr) == want
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_lag_ranges_split_one_text(spark, monkeypatch):
    monkeypatch.setattr(P, "WORK", 2000)
    monkeypatch.setattr(P, "SHARE", 3)
    words = (["a", "b", "a", "c"] * 40) + [str(i % 7) for i in range(150)] + ["z"] * 60
    df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    row = P.periodic_runs(df, long_bytes=10).first()
    raw = [w.encode() for w in words]
    assert [tuple(r) for r in row.runs] == brute(raw) and row.collapsed.encode() == collapsed(raw, brute(raw))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digests(*r) for r in docs), key=repr)
    assert got.where("n_runs > 0").count() > 5
