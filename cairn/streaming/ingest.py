"""Continuous counts over arriving facts: an extension for stores that many scans write to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type.

    On a stream, events that are later than `late` are left out and windows are final when the
    watermark has passed them; on a table all rows count.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
