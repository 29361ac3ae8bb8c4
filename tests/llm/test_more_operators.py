"""Mixing, token rollups, language identification and license scans."""

import collections
import os
import re
import time

import numpy as np
import pytest

from sigloom.llm import language_id, license_scan, mixing, queries
from sigloom.llm import token_rollup as R


def test_mixing_targets_and_cases(spark):
    rows = [(i, "a b c " * (i % 5 + 1), "ab"[i % 2], ["en", None][i % 3 == 0], "x") for i in range(300)] + [(900, None, "a", "en", "x"), (901, "", None, None, "x"), (None, "w", "b", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, row string")
    p = mixing.probabilities(df, {"source": {"a": 0.8, "b": 0.2}}, budget=0.2).collect()
    assert len(p) == len(rows) and all(0 <= r.probability <= 1 for r in p) and not any(r.kept for r in p if not r.tokens)
    sums = collections.Counter()
    for r in p:
        sums[r.source] += r.probability * r.tokens
    assert abs(sums["a"] / (sums["a"] + sums["b"]) - 0.8) < 0.02
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


def test_bounded_mixing_meets_targets(spark):
    """Skewed sources, half of the tokens: cells are full, yet budget and reachable shares are met."""
    rng = np.random.default_rng(3)
    cells = [(f"s{s}", "abc"[k % 3], "xyz"[k % 2], int(10_000 / (s + 1) ** 1.5 * rng.uniform(0.05, 2))) for s in range(12) for k in range(6)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    raked = mixing.rake_bounded(df).collect()
    size = sum(r.tokens for r in raked)
    assert len(raked) == len(cells) and all(0 <= r.drawn <= r.tokens + 1e-6 for r in raked)
    assert any(r.drawn > r.tokens - 1e-6 for r in raked) and abs(sum(r.drawn for r in raked) / (0.5 * size) - 1) < 1e-3
    for d in mixing.DIMENSIONS:
        has, got = collections.Counter(), collections.Counter()
        for r in raked:
            has[r[d]] += r.tokens
            got[r[d]] += r.drawn
        share = {k: v ** mixing.TEMPER[d] for k, v in has.items()}
        high = 1e9
        for _ in range(200):  # the scale at which the values' reachable targets make the budget
            low = high
            full = {k for k in has if low * share[k] >= has[k]}
            high = (0.5 * size - sum(has[k] for k in full)) / sum(share[k] for k in has if k not in full) if len(full) < len(has) else low / 2
        assert all(abs(got[k] - min(has[k], high * share[k])) < 1e-3 * size for k in has), d
    only = {r.source: r.drawn for r in mixing.rake_bounded(df, {"source": {"s0": 0.5, "s1": 0.5}}, budget=0.01).groupBy("source").agg({"drawn": "sum"}).withColumnRenamed("sum(drawn)", "drawn").collect()}
    assert abs(only["s0"] / only["s1"] - 1) < 1e-2 and not only["s2"]


def test_rollup_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 1), (2, "a b c", "s", "de", 1), (3, None, None, "en", 1), (4, "", "s", "en", 1)], "doc_id long, text string, source string, lang string, tokens int")
    counts = R.count_tokens(docs, {"w": None})
    r = R.Rollup(spark, str(tmp_path / "r"))
    assert r.totals(["x"]).count() == 0
    assert r.commit("1", R.inserts(counts)) and not r.commit("1", R.inserts(counts))
    r.commit("2", R.deletes(counts.where("doc_id = 2")))
    after = R.count_tokens(docs.where("doc_id = 1").withColumn("text", docs.text.substr(1, 1)), {"w": None})
    r.commit("3", R.revisions(counts.where("doc_id = 1"), after))
    (marker,) = (tmp_path / "r" / "batches" / "2").glob("*/_SUCCESS")
    os.remove(marker)
    assert r.commit("2", R.deletes(counts.where("doc_id = 2")))
    assert sorted(map(tuple, r.totals(["1", "2", "3", "2", "4"]).collect()), key=repr) == [("s", "en", "w", 2, 1), (None, "en", "w", 1, 0)]


def test_rollup_snapshots_and_two_writers(spark, tmp_path):
    counts = spark.createDataFrame([("s", "en", "w", 5), ("t", None, "w", 7), ("s", "en", "w", 1)], "source string, lang string, version string, tokens long")
    r = R.Rollup(spark, str(tmp_path / "r"))
    total = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert r.batches() == [] and not r.compact() and r.totals().count() == 0
    r.commit("day/1 a", R.inserts(counts))
    # another writer saw no commit and writes the same id
    late = R.Rollup(spark, str(tmp_path / "r"))
    late.committed = lambda batch: False
    assert late.commit("day/1 a", R.inserts(counts))
    assert r.batches() == ["day/1 a"] and total(r.totals()) == [("s", "en", "w", 2, 6), ("t", None, "w", 1, 7)]
    r.commit("2", R.deletes(counts.where("source = 't'")))
    assert r.compact() and not r.compact()
    assert not r.commit("2", R.deletes(counts)) and total(r.totals()) == [("s", "en", "w", 2, 6)]
    r.commit("3", R.inserts(counts.where("source = 't'")))
    want = [("s", "en", "w", 2, 6), ("t", None, "w", 1, 7)]
    assert total(r.totals()) == want == total(r.totals(["day/1 a", "2", "3"]))
    # a snapshot that broke off before its totals stood is passed over
    assert r.compact()
    for marker in (tmp_path / "r" / "snapshots").glob("*/totals/_SUCCESS"):
        os.remove(marker)
    assert total(r.totals()) == want and r.compact() and total(r.totals()) == want


def test_token_query(spark, sf):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=R.PATTERN, mergeable_ranks=dict(R.read_ranks(path)), special_tokens={})
    want, seen = collections.defaultdict(lambda: [0, 0]), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        if r.text not in seen:
            seen.add(r.text)
            t = r.text.replace(" | ", " ")
            for v, n in (("words", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k", len(enc.encode_ordinary(t)))):
                want[r.source, r.lang, v][0] += 1
                want[r.source, r.lang, v][1] += n
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op3_token_counts(spark, sf).collect()}
    assert got == want


def brute_language(pages, langs, table):
    first = []
    for url, html in pages:
        t = language_id._trigrams(language_id.visible(html))
        ll = language_id.TEMPER * table[:, t].sum(1) if len(t) else np.zeros(len(langs))
        tag = (html or "").lower().partition("<html")[2].partition(">")[0]
        m = re.findall(r"\blang\s*=\s*[\"']?([a-z]{2})", tag)
        d = m[-1] if m and m[-1] in langs else None
        u = (url or "").lower()
        host = (re.match(r"[a-z]+://([^/:?#]+)", u) or [0, ""])[1]
        s, p = re.search(r"\.([a-z]{2})$", host), re.match(r"[a-z]+://[^/]+/([a-z]{2})(?:/|$)", u)
        a = next((x[1] for x in (s, p) if x and x[1] in langs), None)
        dom = (re.search(r"([^.]+\.[^.]+)$", host) or [0, host])[1]
        first.append((ll, int(ll.argmax()) if len(t) else None, d, a, host, dom))
    n = len(langs)
    overall = np.ones(n)
    host_n, dom_n = collections.defaultdict(lambda: np.zeros(n)), collections.defaultdict(lambda: np.zeros(n))
    trust = {2: np.ones((n, n)), 3: np.ones((n, n))}
    for f in (f for f in first if f[1] is not None):
        overall[f[1]] += 1
        host_n[f[4]][f[1]] += 1
        dom_n[f[5]][f[1]] += 1
        for k in (2, 3):
            if f[k]:
                trust[k][f[1], langs.index(f[k])] += 1
    overall /= overall.sum()
    out, c = [], language_id.STRENGTH
    for f in first:
        dp = (dom_n[f[5]] + c * overall) / (dom_n[f[5]].sum() + c)
        post = f[0] + np.log((host_n[f[4]] + c * dp) / (host_n[f[4]].sum() + c) if f[4] else overall)
        for k in (2, 3):
            if f[k]:
                post = post + np.log(trust[k] / trust[k].sum(1, keepdims=True))[:, langs.index(f[k])]
        out.append(langs[int(post.argmax())])
    return out


def test_languages(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    langs, table = language_id.fit(docs)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    rows += [(9000, None, None), (9001, "http://a.de", ""), (9002, "x", "<p>"), (9003, rows[0][1], rows[0][2] * 20), (9004, None, rows[1][2]), (9004, None, rows[1][2]), (9005, "http://localhost/x", "<HTML xml:lang='de' lang = en><html lang=fr>"), (9006, None, "<html lang")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, ll string")
    got = {r.page_id: r.lang for r in language_id.identify(df, langs, table).collect()}
    assert [got[i] for i, _, _ in rows] == brute_language([r[1:] for r in rows], langs, table)
    assert language_id.identify(df.limit(0), langs, table).count() == 0
    shown = docs.selectExpr("doc_id page_id", "cast(null as string) url", "text html")
    right = language_id.identify(shown, langs, table).join(docs.selectExpr("doc_id page_id", "lang truth"), "page_id")
    assert right.where("lang = truth").count() > 0.95 * right.count()


TAGS = re.compile(rb"<(script|style|nav|header|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", re.S | re.I)


def test_visible_text():
    pages = ["a<b>c</b>&amp;d", "<!-- x <b> --> y <!-- z", "<script>if (a<b) {}</SCRIPT >t<nav>m</nav", "<style>no end <p>x</p>", "< > <", "<headers>k</headers>", "<!-->ab-->c", "", None]
    for page in pages:
        assert language_id.visible(page) == b" ".join(TAGS.sub(b" ", (page or "").encode()).split()), page


@pytest.mark.parametrize("piece", ["<!-- ", "<script>", "<", "<p ", "&amp", "</script "])
def test_a_megabyte_of_unclosed_tags(piece):
    began = time.process_time()
    language_id.visible(piece * (1_000_000 // len(piece)) + " text")
    assert time.process_time() - began < 20


def test_pages_without_text_count_for_nothing(spark):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat ", "der hund und die katze ")[i % 2] * 9, ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    langs, table = language_id.fit(docs)
    rows = [(i, f"http://h.com/{i}", "") for i in range(200)] + [(1000 + i, f"http://h.com/e{i}", "<p>the cat sat on the mat</p>") for i in range(3)]
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, table).collect()
    assert {r.text_lang for r in got if r.page_id < 1000} == {None} and {r.lang for r in got} == {"en"}
    empty = language_id.identify(spark.createDataFrame(rows[:5], "page_id long, url string, html string"), langs, table).collect()
    assert {r.lang for r in empty} == {"de"} and all(abs(r.confidence - 0.5) < 1e-6 for r in empty)


def test_hostless_pages_have_the_overall_prior(spark):
    """Pages without an address do not make a prior for each other."""
    docs = spark.createDataFrame([(i, ("the cat sat on the mat ", "der hund und die katze ")[i % 2] * 9, ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    langs, table = language_id.fit(docs)
    rows = [(i, None, "<p>der hund und die katze</p>") for i in range(100)] + [(200 + i, f"http://h{i}.com/x", "<p>the cat sat on the mat</p>") for i in range(100)] + [(999, None, "")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, table).collect()}
    assert abs(got[999].confidence - 0.5) < 1e-6 and got[0].lang == "de" and got[200].lang == "en"


def test_unclosed_html_tags_take_linear_time(spark):
    langs, table = ["de", "en"], np.log(np.full((2, language_id.BUCKETS), 1 / language_id.BUCKETS))
    rows = [(1, "http://a.de/x", "<html " * 200_000), (2, None, "<html " + "lang " * 200_000), (3, None, "<html" + " " * 300_000 + "lang=en>")]
    began = time.time()
    got = {r.page_id: r.declared for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langs, table).collect()}
    assert got == {1: None, 2: None, 3: "en"} and time.time() - began < 60


def test_mixing_any_names_and_repeated_rows(spark):
    names = ["topic", "tokens", "probability", "kept", "row", "u", "drawn"]
    rows = [(i // 2, "a b c " * (i % 5), "ab"[i % 2], None, *([i] * len(names))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(df)
    assert got.columns == df.columns and 0 < got.count() < 400 and all(r.kept == r.u == r.topic for r in got.collect())
    p = mixing.probabilities(df, carry=["doc_id", "kept", "tokens", "drawn"])
    assert p.columns == ["doc_id", "drawn", "topic", "tokens", "probability", "kept"] and p.count() == 400


def test_very_long_texts_and_null_ids(spark):
    """Token counts of a text of megabytes, of null and repeated rows; licences of rows with null ids."""
    text = "word, " * 400_000
    df = spark.createDataFrame([(1, text, "s", "en"), (1, text, "s", "en"), (2, None, "s", None), (None, "a b", None, "en")], "doc_id long, text string, source string, lang string")
    counts = R.count_tokens(df, {"w": None})
    assert sorted((r.doc_id or 0, r.tokens) for r in counts.collect()) == [(0, 2), (1, 400_000), (1, 400_000), (2, 0)]
    t = license_scan.TEMPLATES["MIT-grant"]
    rows = spark.createDataFrame([(None, t), (None, "none"), (5, "x " * 200_000 + t), (5, t)], "doc_id long, text string")
    found = [r.doc_id for r in license_scan.scan_licenses(rows).collect() if r.license == "MIT-grant"]
    assert sorted(found, key=repr) == [5, None]


def brute_licenses(rows, templates):
    norm = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    sh = lambda w: [tuple(w)] * (0 < len(w) < 5) or [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return {(d, k) for d, t in rows for k, v in templates.items() if set(sh(norm(v))) and len(set(sh(norm(v))) & set(sh(norm(t)))) >= 0.8 * len(set(sh(norm(v))))}


def test_licenses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    t = license_scan.TEMPLATES
    rows += [(9000, None), (9001, ""), (9002, "... !"), (9003, "x " * 30000 + t["GPL-3.0"] + " y" * 50), (9004, t["MIT-grant"].upper()), (9005, "the " + t["BSD-redistribution"][:-30]), (9006, "MIT License")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = [(r.doc_id, r.license) for r in license_scan.scan_licenses(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_licenses(rows, t) and (9003, "GPL-3.0") in got
    assert license_scan.scan_licenses(df.limit(0)).count() == 0 and license_scan.scan_licenses(df, {"none": "?"}).count() == 0
    assert license_scan.scan_licenses(df, {}).count() == 0


def test_license_windows_at_the_least_containment(spark):
    """65 shingles, the length whose windows are widest against it; 52 of them are left in each of 400 texts."""
    words = [f"t{i}" for i in range(69)]
    rows = []
    for d in range(400):
        changed = list(words)
        for at in (2, 10 + d % 20, 40 + d % 20):
            changed[at] = f"x{d}"
        before, after = ([f"{side}{d}w{i}" for i in range(n)] for side, n in (("a", d * 7 % 300), ("b", 200)))
        rows.append((d, " ".join(before + changed + after)))
        changed[30 + d % 2] = f"y{d}"  # one word more: under the share wanted
        rows.append((1000 + d, " ".join(before + changed + after)))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {"long": " ".join(words)}).collect()
    assert {(r.doc_id, r.containment) for r in got} == {(d, 0.8) for d in range(400)}
