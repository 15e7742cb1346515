"""Event-time counts, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame) -> DataFrame:
    """(window_start, event_type, n, total) by hour of event time."""
    g = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def hourly_counts_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The same of a stream; events later than ``late`` are dropped, finished windows leave the state."""
    return hourly_counts(events.withWatermark("ts", late))
