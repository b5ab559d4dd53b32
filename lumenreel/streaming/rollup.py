"""Event-time windows over an event stream (an extension: frame streams themselves are strictly ordered)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """event_type, hour, n, total; on a stream, with a watermark for late rows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("hour"), "n", "total")
