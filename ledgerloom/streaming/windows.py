"""Sliding-window edges over a stream of resolved transfers, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config


def stream_edges(resolved: DataFrame, config: Config = DEFAULT, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """window_start, window_end, source, target, volume, count. Windows begin at midnight every stride; the leading ones of a stream are partial."""
    timed = resolved.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", f"{config.window_days} days", f"{config.stride_days} days")
    out = timed.groupBy(window.alias("w"), "source", "target").agg(F.sum("adj_sent").alias("volume"), F.count("*").alias("count"))
    return out.select(F.col("w.start").cast("date").alias("window_start"), F.col("w.end").cast("date").alias("window_end"), "source", "target", "volume", "count")
