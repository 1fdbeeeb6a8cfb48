"""Streaming forms of the load aggregations: an extension for feeds that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_sums(events: DataFrame, keys: list[str], t: str, value: str, step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """keys, utc_start, load_mw, n per step; steps are final once the watermark has passed them."""
    windows = events.withWatermark(t, late).groupBy(*keys, F.window(t, step).alias("_w"))
    sums = windows.agg((F.sum(F.round(F.col(value) * 100).cast("long")) / 100.0).alias("load_mw"), F.count("*").alias("n"))
    return sums.select(*keys, F.col("_w.start").alias("utc_start"), "load_mw", "n")


def flagged_sessions(flags: DataFrame, keys: list[str], t: str, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """keys, start, last, points of sessions of flagged points; a session ends after ``gap_seconds`` without one."""
    sessions = flags.withWatermark(t, late).groupBy(*keys, F.session_window(t, f"{gap_seconds} seconds").alias("_s"))
    return sessions.agg(F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("points")).drop("_s")
