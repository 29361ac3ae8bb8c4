"""Language identification by Bayesian evidence fusion.

Four pieces of evidence make a page's posterior: the likelihood of its text
under byte-trigram models, the language that its markup declares, the suffix or
first path part of its address, and a prior of its host. How far declarations
and addresses can be trusted is learned by grouped counts over all pages; the
host's prior is smoothed to its registered domain's, and that to all pages'.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, small_batches

BUCKETS = 1 << 15
#: Documents of each language that fit the trigram models, chosen by hash of the id.
SAMPLE = 2000
#: Trigrams overlap, so their log likelihoods count for less than independent ones.
TEMPER, STRENGTH = 0.25, 5.0
#: Elements whose content isn't text of the page.
_ASIDE = re.compile(rb"<(script|style|nav|header|footer)\b", re.I)
_CLOSE = {n: re.compile(rb"</" + n + rb"\s*>", re.I) for n in (b"script", b"style", b"nav", b"header", b"footer")}
_ENTITY = re.compile(rb"&[a-z#0-9]+;", re.I)


def _trigrams(text: bytes) -> np.ndarray:
    x = np.frombuffer(text.lower(), np.uint8).astype(np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    letters = (x >= 97) & (x <= 122) | (x >= 128) | (x == 32)
    h = (x[:-2] * 65599 + x[1:-1]) * 65599 + x[2:]
    return (h[letters[:-2] & letters[1:-1] & letters[2:]] * 0x9E3779B1 >> 13) & (BUCKETS - 1)


def visible(html: str | None) -> bytes:
    """A page's text: whole asides, comments, tags and entities become spaces.

    One scan: an end that was once not found is never looked for again, so the
    time grows with the length, whatever is left unclosed.
    """
    page, out, at, missing = (html or "").encode(), [], 0, set()

    def past(kind: bytes, start: int) -> int:
        if kind in missing:
            return -1
        if kind in _CLOSE:
            found = _CLOSE[kind].search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(kind, start)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            missing.add(kind)
        return end

    while (i := page.find(b"<", at)) >= 0:
        out.append(page[at:i])
        aside, end = _ASIDE.match(page, i), -1
        if aside:
            end = past(aside[1].lower(), aside.end())
        elif page.startswith(b"<!--", i):
            end = past(b"-->", i + 4)
        if end < 0:
            end = past(b">", i + 1)
        if end < 0:
            out.append(b"<")
            end = i + 1
        else:
            out.append(b" ")
        at = end
    out.append(page[at:])
    return b" ".join(_ENTITY.sub(b" ", b"".join(out)).split())


def _count(batches):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(_trigrams(text.encode()), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities, from ``sample`` documents of each; the result's size is fixed."""
    small_batches(docs.sparkSession)
    langs = sorted(r[0] for r in docs.select(F.col(lang_col)).where(F.col(lang_col).isNotNull()).distinct().collect())
    rank = F.xxhash64(id_col)
    picked = None
    for lang in langs:
        ids = docs.where(F.col(lang_col) == lang).select(F.col(id_col).alias("i"), rank.alias("r")).orderBy("r", "i").limit(sample).select("i")
        picked = ids if picked is None else picked.union(ids)
    table = np.ones((len(langs), BUCKETS))
    if picked is not None:
        chosen = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(materialise(picked.distinct(), "picked"), "i")
        for r in chosen.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True)) if len(langs) else table


def _likelihood(model):
    def run(batches):
        langs, table = model.value
        for batch in batches:
            rows = []
            for html in batch.column(2).to_pylist():
                t = _trigrams(visible(html))
                rows.append((TEMPER * table[:, t].sum(1)).tolist() if len(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64())), *(batch.column(i) for i in (3, 4, 5, 6))], ["page_id", "url", "ll", "declared", "address", "host", "domain"])

    return run


def _log_softmax(ll):
    top = F.array_max(ll)
    total = F.aggregate(F.transform(ll, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(ll, lambda x: x - top - F.log(total))


def identify(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, address, host: one row per page.

    Pages without trigrams of text, and so null and empty ones, have no text_lang:
    they rest on the other evidence and count for none; a page without any gets
    the language of the prior. Ids are integers. Null addresses have no host. ``lang`` ties go to the
    language that sorts first. Without languages lang is null.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url, html = F.col(url_col), F.col(html_col)
    known = F.array(*(F.lit(x) for x in langs)).cast("array<string>")
    valid = lambda c: F.when(F.array_contains(known, F.substring(F.lower(c), 1, 2)), F.substring(F.lower(c), 1, 2))
    low = F.lower(html)
    tag = F.substring_index(F.substr(low, F.locate("<html", low)), ">", 1)  # the first such tag alone, and one anchored match in it: linear in the page
    declared = valid(F.when(F.contains(low, F.lit("<html")), F.regexp_extract(tag, r"(?s)^.*\blang\s*=\s*[\"']?([a-z]{2})", 1)))
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    suffix, part = F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.regexp_extract(F.lower(url), r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    domain = F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"), declared.alias("declared"), F.coalesce(valid(suffix), valid(part)).alias("address"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(domain, F.lit("")).alias("domain"))
    shared = spark.sparkContext.broadcast((langs, table))
    scored = base.mapInArrow(_likelihood(shared), "page_id long, url string, ll array<double>, declared string, address string, host string, domain string")
    if not langs:
        return scored.select(F.col("page_id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "address", "host")
    best = lambda ll: F.element_at(known, F.array_position(ll, F.array_max(ll)).cast("int"))
    told = materialise(scored.withColumn("text_lang", best(F.col("ll"))), "scored")

    def trust(evidence: str) -> DataFrame:
        """Log P(evidence | language), smoothed; counts over all pages that carry it."""
        n = told.where(F.col(evidence).isNotNull()).groupBy("text_lang", evidence).count()
        grid = spark.createDataFrame([(a, b) for a in langs for b in langs], f"text_lang string, {evidence} string")
        full = grid.join(n, ["text_lang", evidence], "left").withColumn("c", F.coalesce("count", F.lit(0)) + 1.0)
        per = full.groupBy("text_lang").agg(F.sum("c").alias("t"))
        rows = full.join(per, "text_lang").groupBy(evidence).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", F.log(F.col("c") / F.col("t")).alias("v")))).alias("m"))
        return rows.select(evidence, F.transform(known, lambda x: F.col("m")[x]).alias(f"ll_{evidence}"))

    counts = told.groupBy("host", "domain").agg(*(F.coalesce(F.sum((F.col("text_lang") == x).cast("double")), F.lit(0.0)).alias(f"n{i}") for i, x in enumerate(langs)))
    hosts = materialise(counts, "hosts")
    arr = lambda p: F.array(*(F.col(f"{p}{i}") for i in range(len(langs))))
    add = [F.sum(f"n{i}").alias(f"d{i}") for i in range(len(langs))]
    all_ = [(x or 0.0) + 1.0 for x in hosts.agg(*add).first()]
    overall = F.array(*(F.lit(x / sum(all_)) for x in all_))
    named = hosts.where("host <> ''")
    domains = named.groupBy("domain").agg(*add)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda n, prior: F.zip_with(n, prior, lambda c, q: (c + STRENGTH * q) / (total(n) + STRENGTH))
    priors = named.join(domains, "domain").withColumn("dp", smooth(arr("d"), overall))
    priors = materialise(priors.select("host", F.transform(smooth(arr("n"), F.col("dp")), lambda x: F.log(x)).alias("prior")), "priors")
    joined = told.join(priors, "host", "left").join(materialise(trust("declared"), "trust"), "declared", "left").join(materialise(trust("address"), "trust"), "address", "left")
    zero = F.array(*(F.lit(0.0) for _ in langs))
    fused = F.coalesce("ll", zero)
    of_all = F.transform(overall, lambda x: F.log(x))
    for c, absent in (("prior", of_all), ("ll_declared", zero), ("ll_address", zero)):
        fused = F.zip_with(fused, F.coalesce(F.col(c), absent), lambda a, b: a + b)
    out = joined.withColumn("post", _log_softmax(fused))
    return out.select(F.col("page_id").alias(id_col), best(F.col("post")).alias("lang"), F.round(F.exp(F.array_max("post")), 6).alias("confidence"), "text_lang", "declared", "address", "host")
