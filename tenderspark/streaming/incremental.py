"""Marts kept up to date by Structured Streaming (an addition: refresh by full reload stays possible).

Every function takes a stream or a table.  Sums are exact decimals, so a table and a stream of its parts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import total

LATE = "10 minutes"


def _timed(events: DataFrame, late: str) -> DataFrame:
    if events.isStreaming:  # watermarks want timestamps with a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def _totals(events: DataFrame, window: Column, late: str, *keys: str) -> DataFrame:
    by = _timed(events, late).groupBy(window.alias("w"), *keys).agg(total(F.col("value")).alias("total"), F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "n")


def windowed_totals(events: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Tumbling totals of `value` by event_type."""
    return _totals(events, F.window("ts", every), late, "event_type").drop("end")


def sliding_totals(events: DataFrame, size: str = "2 hours", every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each event counts in every window that it lies in."""
    return _totals(events, F.window("ts", size, every), late, "event_type")


def session_totals(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Totals of each user's sessions: events no further apart than `gap`."""
    return _totals(events, F.session_window("ts", gap), late, "user_id")


def distinct_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once: state is kept as long as a repeat may still come."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, build=windowed_totals, late: str = LATE) -> None:
    """Take in what is new under `source` (Parquet events), append finished windows to `target`, stop."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    out = build(stream, late=late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
