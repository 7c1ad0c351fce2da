"""Sliding-log limits over events, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_log(events: DataFrame, client: str, ts: str, order: str, seconds: int = 60, limit: int = 30) -> DataFrame:
    """Each request with the number of the client's requests of the last `seconds` (itself included), and whether it is refused."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(client).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count("*").over(window)).withColumn("refused", F.col("in_window") > limit)


def windowed_counts(events: DataFrame, client: str, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests of each client in tumbling windows; works on streams, late rows beyond the watermark are left out there."""
    stamped = events.withColumn("_at", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_at", late) if events.isStreaming else stamped
    return stamped.groupBy(client, F.window("_at", width).alias("w")).agg(F.count("*").alias("n")).select(client, F.col("w.start").alias("start"), "n")
