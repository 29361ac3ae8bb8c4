"""The corpus pipeline: stages over the documents table, each reading what its predecessor wrote.

Toxic documents go, one document of each near-duplicate group stays, benchmark
passages are cut, sources are mixed to target weights, and the rest is dealt to
eight shards. Each stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, minhash_dedup, mixing, sharding, toxicity
from sigloom.llm.storage import materialise

#: Columns that number rows within a stage.
AT, ROW = "_row_at", "_row_number"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches the threshold of their language."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of 5-word shingle similarity 0.8 or more.

    One row of each group stays: rows that share an id are documents of their
    own, an exact repeat goes like any other copy, and a row of null id stays
    only where no row of its group has an id. Rows without words are in no group
    and stay.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        rows, key = docs, "doc_id"
    else:
        rows, key = _numbered(docs), ROW
    groups = minhash_dedup.near_duplicates(rows, id_col=key, shingle=5, percent=80)
    gone = materialise(groups.where("not kept").select(key).distinct(), "gone")
    return rows.join(gone, key, "left_anti").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, in the order of doc_id, nulls last."""
    at = materialise(docs.withColumn(AT, F.monotonically_increasing_id()), "rows")
    order = at.select("doc_id", AT).sort(F.col("doc_id").asc_nulls_last(), AT)
    numbers = materialise(order.select(AT, F.monotonically_increasing_id().alias(ROW)), "numbers")
    return materialise(at.join(numbers, AT).drop(AT), "numbered")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ten words or more, and whole short items, of the benchmark; a document that is mostly such goes."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws half of the tokens at the target weights, raked within what each cell has."""
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard."""
    return sharding.shard(docs, n_shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A trained classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
