"""Streaming extensions: incremental scans and bursts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_files(listings: DataFrame, delay: str = "1 day", time: str = "seen") -> DataFrame:
    """Rows of a stream of listings whose (path, size, modified) wasn't seen within the watermark, which
    bounds the state."""
    return listings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["path", "size", "modified"])


def bursts(events: DataFrame, gap: str = "10 seconds", delay: str = "1 minute", key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, start, end, n): sessions of events no further apart than the gap; late ones are dropped."""
    w = F.session_window(time, gap)
    found = events.withWatermark(time, delay).groupBy(w, key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str = "5 minutes", delay: str = "10 minutes", kind: str = "event_type", time: str = "ts") -> DataFrame:
    """(kind, start, n, total) by tumbling or sliding window."""
    found = events.withWatermark(time, delay).groupBy(F.window(time, size, slide), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(kind, F.col("window.start").alias("start"), "n", "total")
