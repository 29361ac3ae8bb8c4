import re

import numpy as np
import pytest

from sigloom.llm.minhash_dedup import near_duplicates

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = SPACE.findall(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_small_cases(spark, k):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.upper()), (3, base + " more words"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "ONE"), (9, "one two"),
            (10, base.replace("w30", "x30")), (11, "other " * 500), (12, "other " * 300), (13, "é à ü é"), (14, "É À Ü É"), (15, " ".join(f"q{i}" for i in range(30000)))]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, h1 int")
    assert result(near_duplicates(df, shingle=k)) == brute(rows, k)


def test_empty_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (1, 1, True)]


def test_rows_that_share_an_id(spark):
    t, u = (" ".join(f"{p}{i}" for i in range(20)) for p in "tu")
    df = spark.createDataFrame([(5, t), (7, t), (7, u), (9, u), (8, None), (8, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (8, 8, True)}


def test_pairs_just_over_the_threshold(spark):
    """Sets of 90 shingles of which the fewest allowed are shared: every link is found."""
    rng, rows, links = np.random.default_rng(4), [], 0
    for k in range(300):
        n = int(rng.integers(40, 400))
        base = [f"p{k}w{i}" for i in range(n)]
        cut = max(c for c in range(n) if 100 * (n - c - 1) >= 80 * (n - 1 + c))  # the second text holds c words of its own at its end
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - cut] + [f"p{k}x{i}" for i in range(cut)]))]
    want = brute(rows, 2)
    links = sum(not v[2] for v in want.values())
    assert links > 250 and result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)) == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(near_duplicates(docs, shingle=2)) == brute(rows, 2)


@pytest.mark.parametrize("text", ["one two", "one two three"])
def test_short_text_alone_in_a_chunk(spark, text):
    """A partition's chunk of fewer words than a shingle."""
    rows = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    got = near_duplicates(rows, shingle=5, percent=80).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]
