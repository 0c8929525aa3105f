"""Streaming forms of the gap sessions and hourly buckets; late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, ts: str, key: str, gap: str, lateness: str) -> DataFrame:
    """(key, start, end, samples) of runs of samples at most ``gap`` apart."""
    s = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("samples"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples")


def buckets(stream: DataFrame, ts: str, key: str, value: str, width: str, lateness: str) -> DataFrame:
    """(key, start, n, mean, least, most) for each time bucket with samples."""
    s = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), key)
    s = s.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return s.select(key, F.col("w.start").alias("start"), "n", "mean", "least", "most")
