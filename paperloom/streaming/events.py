"""Windows, sessions and ordered de-duplication of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def windowed(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total per event-time window; ``late`` sets a watermark (streams need one to close windows)."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        at = at.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = at.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end, n by gaps in event time; works on streams with a watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        at = at.withWatermark("ts", late)
    got = at.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def sessionize(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Adds a session number per user (batch): it grows where the gap to the event before is above the limit."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    opens = (gap.isNull() | (gap > F.expr(f"interval {minutes} minutes"))).cast("long")
    return events.withColumn("_o", opens).withColumn("session", F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_o")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """Events once per id; state older than the watermark is dropped (streams)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
