"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import ROUNDS, probabilities

    return probabilities(_table(spark, sf_dir, "documents"), rounds=ROUNDS).withColumn("probability", F.round("probability", 6))


#: Where the vocabularies of public tokenizers lie on the driver's machine.
TOKENIZERS = os.environ.get("SIGLOOM_TOKENIZERS", "/opt/tokenizers")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all come, later copies of a text go, table bars leave the texts; two commits are repeated, the second after the sums so far went into a snapshot.

    A null text is no copy of another one and has no tokens.
    """
    from pyspark.sql import functions as F

    from . import token_rollup as R
    from .storage import materialise, new_path

    docs = _table(spark, sf_dir, "documents")
    versions = {"words": None, "byte_bpe_50k": f"{TOKENIZERS}/byte_bpe_50k.tiktoken"}
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n"))
    first = keyed.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(first, ["h1", "h2", "n"]).where("doc_id <> first").select("doc_id")
    counts = materialise(R.count_tokens(docs, versions), "counts")
    gone = materialise(copies, "copies")
    changed = docs.where(F.contains("text", F.lit(" | "))).join(gone, "doc_id", "left_anti").withColumn("text", F.replace("text", F.lit(" | "), F.lit(" ")))
    after = materialise(R.count_tokens(changed, versions), "counts")
    left = counts.join(after.select("doc_id").distinct(), "doc_id", "left_semi")
    rollup = R.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("insert", R.inserts(counts))
    rollup.commit("delete", R.deletes(counts.join(gone, "doc_id", "left_semi")))
    rollup.commit("revise", R.revisions(left, after))
    rollup.commit("delete", R.deletes(counts))
    rollup.compact()
    rollup.commit("insert", R.inserts(counts))
    return rollup.totals()


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    langs, table = fit(_table(spark, sf_dir, "documents"))
    return identify(_table(spark, sf_dir, "pages"), langs, table)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import repeated_lines

    lines = repeated_lines(_table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), allowed=fold != 2)
    return toxicity.score(docs, model, bar=0.3).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), n_shards=8, law="bytes", carry=["doc_id"])


def _fold(column: str = "doc_id"):
    """Unsigned crc32 of the decimal id; null for a null id."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a null id are learned from."""
    from pyspark.sql import functions as F

    from . import lm_scoring

    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.coalesce(_fold() % 7 == 2, F.lit(False)).alias("held_out"))
    model, counts = lm_scoring.fit(docs.where("not held_out"))
    scored = lm_scoring.score(docs.select("doc_id", "held_out", "text"), model, counts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def planted(docs: DataFrame) -> DataFrame:
    """Texts in which a tenth of all documents repeat themselves from some word on; the others stay as they are."""
    from pyspark.sql import functions as F

    h = _fold()
    g = F.floor(h / 10).cast("long")

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        every = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.when(n > 0, F.array_join(F.transform(every, lambda i: F.element_at(words, (at(i) + 1).cast("int"))), " ")).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = F.element_at(F.transform(F.array(words), repeated), 1)  # the words are made once, not once a word
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .periodic_runs import periodic_runs

    found = periodic_runs(planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n", "")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import merkle as M

    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_fold() % 5 == 0, M.digest(*(F.col(c) for c in fields[:-1]), lower))
    rows = M.manifest(docs, fields, carry=[tampered.alias("tampered")])
    folded = M.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

from .oracle import ORACLE  # noqa: E402, F401
