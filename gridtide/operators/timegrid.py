"""Regular grids, label resolution and lag look-ups. All operators take ``keys``: the columns that name a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.functions.time import exists_locally, floor_to, plus, to_utc

LABEL = "dd.MM.yyyy HH:mm"


def spine(bounds: DataFrame, step: int, name: str = "utc_start") -> DataFrame:
    """A row per step from ``first`` to ``last`` (both included) for every row of ``bounds``."""
    rest = [c for c in bounds.columns if c not in ("first", "last")]
    return bounds.select(*rest, F.explode(F.sequence("first", "last", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step)))).alias(name))


def on_grid(df: DataFrame, keys: list[str], bounds: DataFrame, step: int, t: str = "utc_start") -> DataFrame:
    """``df`` on the regular grid of ``bounds``: gaps become rows of NULLs. (keys, t) must be unique in ``df``."""
    return spine(bounds, step, t).join(df, [*keys, t], "left")


def own_bounds(df: DataFrame, keys: list[str], t: str = "utc_start") -> DataFrame:
    """Each series' first and last time."""
    return df.groupBy(*keys).agg(F.min(t).alias("first"), F.max(t).alias("last"))


def regular(df: DataFrame, keys: list[str], step: int, t: str = "utc_start") -> DataFrame:
    """The grid between each series' own ends."""
    return on_grid(df, keys, own_bounds(df, keys, t), step, t)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: an aggregation, so a key's rows never meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def lags(df: DataFrame, keys: list[str], value: str, hours: dict[str, int], t: str = "utc_start") -> DataFrame:
    """Per (keys, t): the value ``hours`` earlier under each name.

    Each row is sent to the times that look back at it and one aggregation gathers them: one shuffle, however many
    lags, instead of a self-join for each. Times without a row of their own appear as well; join to the spine.
    """
    later = F.explode(F.array(*[F.lit(h) for h in sorted(set(hours.values()))])).alias("_h")
    sent = df.select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v"), later).withColumn("_t", plus(F.col("_t"), F.col("_h") * 3600))
    return sent.groupBy(*keys, F.col("_t").alias(t)).agg(*[F.max(F.when(F.col("_h") == h, F.col("_v"))).alias(n) for n, h in hours.items()])


def label_convention(df: DataFrame, file: str = "file", label: str = "label", row: str = "row_no") -> DataFrame:
    """Per file: ``end`` where the first label is 01.01. 00:15, ``start`` where it is 00:00, NULL for any other."""
    first = df.groupBy(file).agg(F.min_by(label, row).alias("first_label"))
    clock = F.regexp_extract("first_label", r"^01\.01\.[0-9]{4} (00:[0-9]{2})$", 1)
    return first.withColumn("convention", F.when(clock == "00:15", "end").when(clock == "00:00", "start"))


def checked_convention(conventions: DataFrame, file: str = "file") -> DataFrame:
    """The rows of label_convention unchanged; the job fails where a file's first label is of neither convention."""
    said = F.concat(F.lit("unknown label convention in "), F.coalesce(F.col(file).cast("string"), F.lit("a file")), F.lit(": "), F.coalesce("first_label", F.lit("no label")))
    return conventions.filter(F.when(F.col("convention").isNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def checked_instants(rows: DataFrame, label: str = "label") -> DataFrame:
    """The rows of resolve_labels unchanged; the job fails at a label that the clock skips or that is no local time."""
    said = F.concat(F.lit("no such local time: "), F.coalesce(F.col(label), F.lit("no label")))
    return rows.filter(F.when(~F.col("valid"), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def resolve_labels(df: DataFrame, tz: str, step: int = 900, file: str = "file", label: str = "label", row: str = "row_no", convention: str = "convention") -> DataFrame:
    """Adds occurrence, utc_start and valid to local end or start labels.

    The first occurrence of a label that the clock change repeats is summer time, a later one winter time; labels
    that the clock skips are not valid and have no instant.
    """
    nth = F.row_number().over(Window.partitionBy(file, label).orderBy(row))
    local = F.to_timestamp_ntz(F.col(label), F.lit(LABEL))
    rows = df.withColumn("occurrence", nth).withColumn("_local", local)
    first = to_utc(F.col("_local"), tz)
    # A repeated local time maps to its first instant; the second is an hour later, if it still shows that label.
    second = plus(first, 3600)
    again = (F.col("occurrence") > 1) & (F.convert_timezone(F.lit("UTC"), F.lit(tz), second) == F.col("_local"))
    shift = F.when(F.col(convention) == "end", -step).otherwise(0)
    valid = F.coalesce(exists_locally(F.col("_local"), tz), F.lit(False))
    return rows.withColumn("valid", valid).withColumn("utc_start", F.when(valid, plus(F.when(again, second).otherwise(first), shift))).drop("_local")


def local_day_counts(df: DataFrame, file: str, label: str, convention: Column, per_day: int = 96, step: int = 900) -> DataFrame:
    """Days whose number of labels differs from ``per_day``; an end label of 00:00 belongs to the day before."""
    local = F.to_timestamp_ntz(F.col(label), F.lit(LABEL))
    day = F.to_date(plus(local, F.when(convention == "end", -step).otherwise(0)))
    return df.groupBy(file, day.alias("local_date")).agg(F.count("*").alias("n")).filter(F.col("n") != per_day)


def spread_to_steps(df: DataFrame, keys: list[str], flag: str, coarse: int, points: DataFrame, t: str = "utc_start") -> DataFrame:
    """A coarse flag on fine points: equi-join on the truncated time; points without one are false."""
    known = df.select(*keys, F.col(t).alias("_coarse"), F.col(flag))
    return points.withColumn("_coarse", floor_to(F.col(t), coarse)).join(known, [*keys, "_coarse"], "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_coarse")
