"""Tables behind plots and text exports of an extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import sort_channels, to_wide

#: Genome builds that decomposition knows; others fall back to the first.
BUILDS = ["GRCh37", "GRCh38", "mm9", "mm10", "mm39", "rn6", "rn7"]


def genome_build(name: str) -> tuple[str, str | None]:
    """The build to use and, where another was asked for, a line for the log."""
    return (name, None) if name in BUILDS else (BUILDS[0], f"{name} is not a known build; {BUILDS[0]} is used")


def signature_profile(signatures: DataFrame) -> DataFrame:
    """(signature, channel, weight, percent) for bar plots."""
    return signatures.select("signature", "channel", "weight", (100 * F.col("weight") / F.sum("weight").over(Window.partitionBy("signature"))).alias("percent"))


def activity_share(activities: DataFrame) -> DataFrame:
    """(sample, signature, activity, share) for stacked bars; a sample without activity has null shares."""
    return activities.select("sample", "signature", "activity", F.try_divide("activity", F.sum("activity").over(Window.partitionBy("sample"))).alias("share"))


def burden(activities: DataFrame, megabases: float = 2800.0) -> DataFrame:
    """(signature, sample, per_mb, log10_per_mb) of positive activities; the genome's size is the caller's."""
    rows = activities.where("activity > 0").select("signature", "sample", (F.col("activity") / megabases).alias("per_mb"))
    return rows.withColumn("log10_per_mb", F.log10("per_mb"))


def selection_curve(rank_stats: DataFrame, similarity: DataFrame) -> DataFrame:
    """(k, avg_stability, mean_cosine_distance) by rank."""
    far = similarity.groupBy("k").agg(F.avg(1 - F.col("cosine")).alias("mean_cosine_distance"))
    return rank_stats.select("k", "avg_stability").join(far, "k")


def signature_stats(stability: DataFrame, activities: DataFrame) -> DataFrame:
    """``stability(k, signature, stability)`` with whole-number totals of activities."""
    total = activities.groupBy("k", "signature").agg(F.sum("activity").cast("long").alias("total"))
    return stability.join(total, ["k", "signature"])


def scientific(df: DataFrame, *cols: str) -> DataFrame:
    """Columns as ``1.23E-04`` texts; an exact tie rounds away from zero."""
    return df.withColumns({c: F.format_string("%.2E", F.col(c).cast("double")) for c in cols})


def write_wide(cells: DataFrame, path: str, rows: str, columns: str, value: str, names: list[str] | None = None, order: DataFrame | None = None, digits: bool = False) -> None:
    """A tab-separated matrix with a header, as users of spreadsheets expect; one row per ``rows`` value.

    ``order(channel, channel_idx)``: the order of the rows; without it they come as they are dealt. ``digits``: values as ``1.23E-04``.
    """
    long = cells.select(F.col(rows).alias("channel"), F.col(columns).alias("sample"), F.col(value).alias("cnt"))
    wide = to_wide(long, names)
    if order is not None:
        wide = sort_channels(wide, order)
    if digits:
        wide = scientific(wide, *(c for c in wide.columns if c != "channel"))
    wide.withColumnRenamed("channel", rows).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
