"""Exact order statistics without bringing a group's values to one task.

Each asked rank starts with all of its group's values. While more than ``FEW`` are left, approximate quantiles cut them:
an interval between two neighbouring cuts, or a cut itself, holds the rank as counts tell, and only that is kept. A
step leaves at most a fiftieth (what lies between two cuts) or a single value however often it occurs, so steps are few
and the last one ranks a bounded number of values. The answer is exact whatever the quantiles' error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.sources.store import kept

EDGES = 63
#: A rank is looked up among so many values at most.
FEW = 65_536


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join by groups, missing keys too; without groups the right side is a few rows."""
    if not by:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(named[f"_{c}"])
    return left.join(named, same).drop(*[f"_{c}" for c in by])


def _inside(known: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """The values that each asked rank still looks at: strictly between its bounds, where it has such."""
    rows = _beside(known, asked.select(*by, "_k", "_rank", "_lo", "_hi"), by)
    return rows.filter("(_lo is null or _v > _lo) and (_hi is null or _v < _hi)")


def _narrowed(known: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """The asked ranks with bounds that hold a fiftieth of the values, or their value."""
    group = [*by, "_k"]
    inside = _inside(known, asked, by)
    probabilities = F.array(*[F.lit((k + 1) / (EDGES + 1)) for k in range(EDGES)])
    cuts = inside.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", probabilities, F.lit(1000)))).alias("_cuts"))
    binned = _beside(inside.select(*group, "_v"), cuts, group)
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    part = 2 * below + F.array_contains("_cuts", F.col("_v")).cast("int")  # odd: a cut itself
    counts = binned.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy("_part")))  # 2 EDGES + 1 rows
    rows = _beside(counts, asked.drop("_size", "_found"), group)
    held = rows.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
    held = _beside(held, cuts, group)
    at = F.col("_part").cast("int")
    single, i = at % 2 == 1, F.floor(at / 2).cast("int")
    return held.select(
        *by,
        "n",
        "_k",
        (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"),
        F.when(~single & (i > 0), F.get("_cuts", i - 1)).otherwise(F.col("_lo")).alias("_lo"),
        F.when(~single & (i < F.size("_cuts")), F.get("_cuts", i)).otherwise(F.col("_hi")).alias("_hi"),
        F.col("_c").alias("_size"),
        F.when(single, F.get("_cuts", i)).alias("_found"),
    )


def ranked(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """by, n, values: of each group's known values the ones at ``ranks`` (of their number n, from 1), in that order.

    A group without a known value gives no row, and an empty table none, with or without ``by``. NULL keys are a group.
    """
    known = kept(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), "order-values")
    kind = known.schema["_v"].dataType
    sizes = known.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0")
    asked = sizes.select(*by, "n", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("_k", "_rank"))
    nothing = F.lit(None).cast(kind)
    asked = kept(asked.select(*by, "n", "_k", "_rank", nothing.alias("_lo"), nothing.alias("_hi"), F.col("n").alias("_size"), nothing.alias("_found")), "order-asked")
    while (asked.filter("_found is null").agg(F.max("_size")).first()[0] or 0) > FEW:
        wide = F.col("_found").isNull() & (F.col("_size") > FEW)
        asked = kept(_narrowed(known, asked.filter(wide), by).unionByName(asked.filter(~wide)), "order-asked")
    group = [*by, "_k"]
    few = _inside(known, asked.filter("_found is null"), by).groupBy(*group, "_rank", "_v").agg(F.count("*").alias("_c"))
    at = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))  # FEW values
    last = few.withColumn("_at", at).filter(F.col("_at") >= F.col("_rank")).groupBy(*group).agg(F.min("_v").alias("_v"))
    found = _beside(asked.filter("_found is null").select(*group, "n"), last, group)
    found = found.unionByName(asked.filter("_found is not null").select(*group, "n", F.col("_found").alias("_v")))
    listed = found.groupBy(*by).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_s"))
    return listed.filter("n is not null").select(*by, "n", F.transform("_s", lambda s: s["_v"]).alias("values"))


def quantile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by, ``name``: the linear-interpolated ``q`` quantile of each group's known values; groups without one are left out."""

    def place(n: Column) -> Column:
        return (n - 1) * F.lit(float(q))

    two = ranked(df, by, value, lambda n: [F.floor(place(n)) + 1, F.ceil(place(n)) + 1])
    low, part = F.get("values", F.lit(0)), place(F.col("n")) - F.floor(place(F.col("n")))
    return two.select(*by, (low + (F.get("values", F.lit(1)) - low) * part).alias(name))
