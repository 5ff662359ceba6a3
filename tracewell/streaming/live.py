"""Streaming forms of the operators that are causal: tumbling means and burst sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_means(stream: DataFrame, key: str, time: str, value: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, start, mean, n) per fixed window; rows later than ``late`` are left out."""
    held = stream.withWatermark(time, late)
    return held.groupBy(key, F.window(time, width).alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "mean", "n")


def burst_sessions(stream: DataFrame, key: str, time: str, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, n) per session of events closer than ``gap``; sessions of one event are dropped."""
    held = stream.withWatermark(time, late)
    grouped = held.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("start <> end").select(key, "start", "end", "n")
