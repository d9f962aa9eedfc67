"""Event streams: windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of events by window and keys; works on a stream and on a table alike.

    On a stream, events later than the watermark are left out and windows older than it are final.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "value")
