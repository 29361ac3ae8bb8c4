import random
import re

from pyspark.sql import functions as F

from sigloom.llm import line_dedup
from sigloom.llm.line_dedup import dedup_lines, repeated_lines
from sigloom.llm.storage import materialise

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, jaccard=0.8):
    sets, out, by_word = [], set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for l, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in line.encode())))
            near = {k for w in s for k in by_word.get(w, ())}
            removed = any(len(s & sets[k]) >= jaccard * len(s | sets[k]) - 1e-9 for k in near)
            out.add((d, l, removed))
            for w in s:
                by_word.setdefault(w, []).append(len(sets))
            sets.append(s)
    return out


def result(df):
    return {tuple(r) for r in df.collect()}


def test_cases(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(base) + "\n\nshort one\n"), (2, None), (3, ""), (4, "\n\n ... \n"), (5, "Short ONE!\n" + " ".join(base[::-1])), (6, " ".join(base[:18]) + "\n" + " ".join(base[:15])), (7, "a\na\na b c d e\na b c d e f"), (8, " ".join(f"v{i}" for i in range(9000)) + "\né à ü é\nÉ"), (9, "é à ü")]
    rows += [(20 + i, "\n".join(" ".join([*base[:j], f"x{i}", *base[j + 1 :]]) for j in (3, 7))) for i in range(40)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int")
    assert result(repeated_lines(df)) == brute(rows)
    cleaned = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert cleaned[7] == "a\na b c d e" and cleaned[2] is None and cleaned[1] == rows[0][1]
    assert repeated_lines(df.limit(0)).count() == 0
    named = df.selectExpr("*", "doc_id _id", "n _gone", "n `key`", "n gone", "n `left`", "n `row`", "text line")
    assert dedup_lines(named).columns == named.columns and {r.doc_id: r.text for r in dedup_lines(named).collect()} == cleaned


def test_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(repeated_lines(d)) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_null_and_shared_ids(spark):
    line = "one two three four five"
    df = spark.createDataFrame([(None, line), (None, "x\n" + line), (1, line), (1, line), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, repeated_lines(df).collect()), key=repr)
    # null ids stand first, as one document; its lines at place 0 differ, the equal one at place 1 goes; equal lines of id 1 share one fate
    assert got == sorted([(None, 0, False), (None, 0, False), (None, 1, True), (1, 0, True), (1, 0, True), (2, 0, False)], key=repr)


def test_thresholds_and_sizes(spark):
    """Keys of two words and of one, long lines, sizes at the filters' bounds."""
    rng = random.Random(7)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(rng.choice((3, 5, 9, 20, 60, 150)))] + [f"c{rng.randrange(5)}" for _ in range(3)]
        for i in range(12):
            some = [w for w in base if rng.random() > 0.12] + [f"n{rng.randrange(9)}" for _ in range(rng.randrange(1 + len(base) // 6))]
            rows.append((100 * i + g, rng.choice((" ", ", ", "-")).join(rng.sample(some, len(some)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for jaccard in (0.55, 0.7, 0.8, 0.95):
        assert result(repeated_lines(df, jaccard=jaccard)) == brute(rows, jaccard)


def test_ids_far_apart(spark):
    rows = [(-(1 << 62), "a b c d e"), (0, "x y\na b c d e f"), ((1 << 63) - 1, "f e d c b a\nz")]
    assert result(repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_group_meets_in_few_pairs(spark, monkeypatch):
    """Near copies, most of them similar to some line before them: pairs tried stay far under the square, no pair twice."""
    rng, tried = random.Random(3), []
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.06 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(400)]
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name="step", options=None: tried.append(out.count()) or out if (out := materialise(df, name, options)) is not None and name == "pairs" else out)
    assert result(repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(tried) < 400 * 400 / 8


def test_small_keys_are_done_in_the_first_round(spark, monkeypatch):
    """Lines of one common pair of rare words, otherwise unlike: no row of a key of few lines goes on to the second round."""
    rows = [(10 * g + i, f"g{g}a g{g}b " + " ".join(f"u{g}x{i}y{j}" for j in range(4))) for g in range(30) for i in range(9)]
    rows += [(1000 + i, " ".join(f"common{j}" for j in range(8)) + f" v{i}") for i in range(9)]
    met = []
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name="step", options=None: met.append(out.where("size(b) = 0").count()) or out if (out := materialise(df, name, options)) is not None and name == "met" else out)
    # all words are as rare as each other, so that each group's pair may be a key
    monkeypatch.setattr(line_dedup, "_rarity", lambda tokens: F.array_repeat(F.lit(0).cast("long"), line_dedup.CELLS))
    monkeypatch.setattr(line_dedup, "_prefix", lambda n, jaccard: n - 1)
    assert result(repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(met) == 0
