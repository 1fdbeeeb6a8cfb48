"""Ordered operators over long series.

A window over a whole series would put it in one task. Here a series is cut into blocks of time; ``halo`` copies the
few rows that look-backs and look-aheads need into the neighbouring blocks, and what may reach further (the last
known value, the start of a run) is carried between blocks through a table with a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridtide.functions.time import epoch_seconds, plus, seconds_between

BLOCK = 30 * 86_400


def _block(t: Column, span: int) -> Column:
    return F.floor(epoch_seconds(t) / span)


def halo(df: DataFrame, back: int, ahead: int = 0, t: str = "utc_start", span: int = BLOCK) -> DataFrame:
    """Rows in their block (``_own``) and in the blocks whose rows look at them from within back/ahead seconds."""
    first, last = _block(plus(F.col(t), -ahead), span), _block(plus(F.col(t), back), span)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == _block(F.col(t), span))


def owned(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block")


def in_block(keys: list[str], t: str = "utc_start") -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(t)


def guarded(agg: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    """A rolling aggregate, missing where the frame has fewer than ``least`` known values."""
    return F.when(F.count(value).over(frame) >= least, agg.over(frame))


def rolling(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, str, int, int, int]], step: int, t: str = "utc_start", span: int = BLOCK) -> DataFrame:
    """Adds rolling aggregates on a regular grid: name -> (value, function, rows back, rows ahead, least known).

    Functions: mean, std, median, lag and lead (rows back or ahead; the rest ignored), diff (to the row before).
    """
    back, ahead = max(c[2] for c in columns.values()) * step, max(c[3] for c in columns.values()) * step
    rows, w = halo(df, back, ahead, t, span), in_block(keys, t)
    for name, (value, function, behind, before, least) in columns.items():
        x, frame = F.col(value), w.rowsBetween(-behind, before)
        made = {
            "mean": lambda: guarded(F.avg(x), x, frame, least),
            "std": lambda: guarded(F.stddev_samp(x), x, frame, least),
            "median": lambda: guarded(F.percentile(x, F.lit(0.5)), x, frame, least),
            "lag": lambda: F.lag(x, behind).over(w),
            "lead": lambda: F.lead(x, before).over(w),
            "diff": lambda: x - F.lag(x, behind).over(w),
        }[function]()
        rows = rows.withColumn(name, made)
    return owned(rows)


def neighbours(df: DataFrame, keys: list[str], value: str, t: str = "utc_start", span: int = BLOCK) -> DataFrame:
    """Adds prev_v, prev_t, next_v, next_t: the nearest known value at or before, and at or after, each row."""
    rows = df.withColumn("_block", _block(F.col(t), span)).withColumn("_at", F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(t).alias("t"))))
    inside = Window.partitionBy(*keys, "_block").orderBy(t)
    upto, on = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col(t))).alias("_last"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col(t))).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = ends.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    near = rows.withColumn("_p", F.last("_at", ignorenulls=True).over(upto)).withColumn("_n", F.first("_at", ignorenulls=True).over(on)).join(carried, [*keys, "_block"])
    near = near.withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    named = [F.col("_p.v").alias("prev_v"), F.col("_p.t").alias("prev_t"), F.col("_n.v").alias("next_v"), F.col("_n.t").alias("next_t")]
    return near.select(*df.columns, *named)


def interpolated(df: DataFrame, keys: list[str], value: str | list[str], step: int, limit: int, long_gaps: str = "first", t: str = "utc_start", span: int = BLOCK) -> DataFrame:
    """Linear in time between known values, on a regular grid; ``value`` is replaced and ``interpolated`` added.

    Only between two known values. A gap longer than ``limit`` steps has its first ``limit`` filled ("first") or
    stays missing as a whole ("keep"). Several values that are missing together are filled in one pass.
    """
    if long_gaps not in ("first", "keep"):
        raise ValueError("long_gaps is first or keep")
    values = [value] if isinstance(value, str) else value
    first = F.col(values[0])
    rows = df.withColumn("_values", F.when(first.isNotNull(), F.struct(*values)))
    near = neighbours(rows, keys, "_values", t, span)
    since, gap = seconds_between(F.col("prev_t"), F.col(t)), seconds_between(F.col("prev_t"), F.col("next_t"))
    reach = since <= limit * step if long_gaps == "first" else gap <= (limit + 1) * step
    filled = first.isNull() & F.col("prev_v").isNotNull() & F.col("next_v").isNotNull() & reach

    def line(v: str) -> Column:
        before, after = F.col(f"prev_v.{v}"), F.col(f"next_v.{v}")
        return F.when(filled, before + (after - before) * since / gap).otherwise(F.col(v)).alias(v)

    rest = [c for c in df.columns if c not in values]
    return near.select(*rest, *map(line, values), filled.alias("interpolated"))


def runs(df: DataFrame, keys: list[str], value: str, step: int, t: str = "utc_start", span: int = BLOCK) -> DataFrame:
    """Adds run_start and run_size of runs of equal values on a regular grid; every missing value is its own run."""
    changed = F.coalesce(F.col(value) != F.lag(value).over(in_block(keys, t)), F.lit(True))
    marked = halo(df, step, 0, t, span).withColumn("_new", F.when(changed, F.col(t))).filter("_own")
    upto = in_block(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy(*keys, "_block").agg(F.max("_new").alias("_last"))
    carried = ends.select(*keys, "_block", F.max("_last").over(across).alias("_before"))
    named = marked.withColumn("_here", F.max("_new").over(upto)).join(carried, [*keys, "_block"]).withColumn("run_start", F.coalesce("_here", "_before"))
    sizes = named.groupBy(*keys, "run_start").agg(F.count("*").alias("run_size"))
    return named.join(sizes, [*keys, "run_start"]).select(*df.columns, "run_start", "run_size")


def flag_runs(flagged: DataFrame, keys: list[str], max_gap: int, step: int, t: str = "utc_start", extra: list[Column] | None = None) -> DataFrame:
    """Spans (start, end) of flagged points: a new one where the gap exceeds max_gap + step; end = last + step."""
    session = F.session_window(F.col(t).cast("timestamp_ntz"), f"{max_gap + step} seconds")
    return flagged.groupBy(*keys, session.alias("_s")).agg(F.min(t).alias("start"), plus(F.max(t), step).alias("end"), *(extra or [])).drop("_s")


def densest(df: DataFrame, keys: list[str], seconds: int, t: str = "start") -> DataFrame:
    """Per key: the event from which the most events start within ``seconds`` (strictly), the earliest of ties."""
    w = Window.partitionBy(*keys).orderBy(epoch_seconds(F.col(t))).rangeBetween(0, seconds - 1)
    counted = df.withColumn("_n", F.count("*").over(w))
    return counted.groupBy(*keys).agg(F.max("_n").alias("events"), F.max_by(t, F.struct(F.col("_n"), -epoch_seconds(F.col(t)))).alias("start"))
