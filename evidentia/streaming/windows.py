"""Windows over event streams: an extension beyond the batch operators. The same code runs on a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """start, event_type, n, total by hour; `late` sets the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    by = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_arrivals(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: repeated deliveries are dropped with bounded state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
