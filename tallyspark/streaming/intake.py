"""Statements as a stream: late copies dropped, windows and sessions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source", "reference", "amount_paise", "occurred_at"]


def without_copies(rows: DataFrame, delay: str = "3 days") -> DataFrame:
    """A stream of transactions without exact copies that arrive within the delay; state is dropped after it."""
    return rows.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(KEY)


def windowed(events: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in windows of event time."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("paise")).select(F.col("window.start").alias("start"), "event_type", "n", "paise")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events with no gap between them."""
    rows = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def append(rows: DataFrame, path: str, checkpoint: str):
    """Start writing a stream to an append-only Parquet table; everything that is there now is taken, then the query ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
