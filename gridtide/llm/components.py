"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shared import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the smallest id that the node sees.

    Per-node minima are pre-aggregated and joined back, so no neighbourhood is ever gathered in one row.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    kept = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (smallest id reachable) for every node of ``edges`` (a long, b long); loops are ignored."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        large = stored(_stars(now, True), label)
        small = stored(_stars(large, False), label)
        dropped(now)
        dropped(large)
        now = small
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
