"""Running popularity of event types over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, key, n: counts by event-time window; events later than the watermark are dropped.

    Works on a batch as on a stream; the state of a stream is bounded by the watermark.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    counted = timed.groupBy(F.window("__t", window), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")
