"""Incremental catalogue: counts of a stream of events by channel and sample (an extension; the batch form is ``count_events``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_counts(events: DataFrame, channel: Column, sample: Column, time: str | None = None, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per channel and sample; with ``time`` per window too, and state older than ``late`` is dropped."""
    named = events.withColumns({"channel": channel, "sample": sample})
    if time is None:
        return named.groupBy("channel", "sample").agg(F.count("*").alias("cnt"))
    return named.withWatermark(time, late).groupBy(F.window(time, window), "channel", "sample").agg(F.count("*").alias("cnt"))
