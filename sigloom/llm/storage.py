"""Intermediate tables in the folder that all executors share.

A written table cuts lineage as ``checkpoint()`` does: it survives the loss of
any executor. Unlike an RDD checkpoint it also keeps exact size statistics, so
Spark picks a broadcast join only where the table is known to be small.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_base


def shared_dir(spark: SparkSession) -> str:
    """This application's place in the folder that all executors share."""
    return f"{shared_base(spark)}/sigloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str = "step", options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with ``options`` of the Parquet writer, and return the table read back.

    The shuffle files behind it go as soon as the table stands, not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        home = shared_dir(df.sparkSession)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/sigloom-{df.sparkSession.sparkContext.applicationId}/" in folder and home:
                _delete(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet written elsewhere go with them."""
    _delete(spark, shared_dir(spark))


def prune_by_bloom(spark: SparkSession) -> None:
    """Let Spark drop the rows of a large scan before a shuffle join with a small filtered table.

    Its runtime Bloom filters are bounded by Spark's own size settings; here they
    are also allowed for scans under 10 GB.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that a run of very long texts fits a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
