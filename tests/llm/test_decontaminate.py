import hashlib
import re

from sigloom.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for m in sizes:
                if (found := grams.get(tuple(w[k : k + m]))) and k + m <= len(w):
                    hit |= set(range(k, k + m))
                    ids |= found
        names = sorted(str(i) for i in ids if i is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def cases():
    long = " ".join(f"k{i}" for i in range(25))
    items = [(1, long), (2, "short Item"), (3, "solo"), (4, None), (5, ""), (6, "..."), (10, long), (11, " ".join(f"k{i}" for i in range(5, 17))), (12, "a b a b a b a b a b a b a b"), (13, "é ü")]
    docs = [(1, "x " + long + " y"), (2, None), (3, ""), (4, "?!"), (5, "the SHORT, item here"), (6, "solo solo"), (7, " ".join(f"k{i}" for i in range(3, 12))), (8, " ".join(f"K{i}" for i in range(3, 13)) + " solo"),
            (9, "b a b a b a b a b a b a b"), (10, long.replace("k12", "zz")), (11, "É ü"), (12, "é ü"), (13, "w " * 40000 + long), (14, "short item short item")]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 hits", "2 found", "3 id")
    i = spark.createDataFrame([*items, (None, "k0 k1 zq"), (1, items[0][1])], "item_id long, text string")
    want = brute(docs, [*items, (None, "k0 k1 zq")])
    assert result(D.contamination(d, i)) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert result(D.contamination(d, i)) == want


def test_empty_tables(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(d.limit(0), i).count() == 0
    assert not any(r.contaminated for r in D.contamination(d, i.limit(0)).collect())


def test_cleaned_texts(spark):
    docs, items = cases()
    d = spark.createDataFrame([(k, t, len(t or "")) for k, t in docs], "doc_id long, text string, n_chars long")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(d, i).collect()}
    want = brute(docs, items)
    for k, t in docs:
        n, hit = want[k][:2]
        if hit > n / 2:
            assert k not in got
        elif not hit:
            assert got[k].text == t
        else:
            assert brute([(k, got[k].text)], items)[k][1] == 0 and got[k].n_chars == len(got[k].text)


def test_whole_table(spark, sf):
    d, i = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])
    assert result(D.contamination(d, i)) == want and any(v[4] for v in want.values())


def test_blocks_do_not_show_in_cleaned_texts(spark, monkeypatch):
    a, b, c = (" ".join(f"{p}{i}" for i in range(12)) for p in "abc")
    other = " ".join(f"o{i}" for i in range(6))
    items = [(1, a), (2, b), (3, " ".join([*a.split()[6:], *c.split()])), (4, "left right"), (5, "u v w")]
    docs = [(1, f"{a} {other} {b}"),  # 12 and 12 of 30 words, in two blocks
            (2, f"{other} {other} {other} {other} {' '.join(a.split() + c.split())} {other}"),  # spans of two items overlap
            (3, f"{other} {other} {other} left {b} right {other}"),  # a cut joins the words of an item
            (4, f"{other} {other} left u v {b} w right"), (5, other), (6, None), (7, "")]
    d = spark.createDataFrame([(t, k, len(t or "")) for k, t in docs], "text string, hits long, n_chars long")
    i = spark.createDataFrame(items, "item_id long, text string")
    one = {r.hits: r for r in D.decontaminate(d, i).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    got = D.decontaminate(d, i)
    assert got.columns == d.columns and {r.hits: r for r in got.collect()} == one
    assert 1 not in one and "left" not in one[3].text and 2 in one
    for span in (2, 13):
        monkeypatch.undo()
        want = sorted(map(tuple, D.decontaminate(d, i, min_span=span).collect()), key=repr)
        monkeypatch.setattr(D, "BLOCK_BYTES", 20)
        assert sorted(map(tuple, D.decontaminate(d, i, min_span=span).collect()), key=repr) == want
