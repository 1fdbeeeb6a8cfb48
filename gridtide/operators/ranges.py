"""Joins on half-open time ranges, as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.time import epoch_seconds


def in_spans(points: DataFrame, spans: DataFrame, keys: list[str], bucket: int, t: str = "utc_start", how: str = "inner") -> DataFrame:
    """points joined to spans with start <= t < end.

    Spans are repeated per bucket of ``bucket`` seconds that they touch, points look into their own bucket: a hash
    or sort-merge join instead of a nested loop. ``how``: inner, left, left_semi or left_anti, from the points.
    """
    first, last = F.floor(epoch_seconds(F.col("start")) / bucket), F.floor((epoch_seconds(F.col("end")) - 1) / bucket)
    cut = spans.filter(F.col("start") < F.col("end")).withColumn("_b", F.explode(F.sequence(first, last))).withColumnsRenamed({k: f"_{k}" for k in keys})
    at = points.withColumn("_bucket", F.floor(epoch_seconds(F.col(t)) / bucket))
    match = (F.col("_bucket") == F.col("_b")) & (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return at.join(cut, match, how).drop("_bucket", "_b", *[f"_{k}" for k in keys])
