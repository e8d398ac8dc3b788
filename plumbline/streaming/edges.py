"""Incremental upkeep of aggregated edges over an event stream (an extension; the batch operators do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """events (ts, event_type, user_id) -> occurrences and users of each type and window; events later than `late` behind
    the watermark are dropped. Works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("occurrences"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), "event_type", "occurrences", "users")
