"""From parsed labels and values to a gap-free quarter-hour series, its hourly means and a validation record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.time import floor_to, seconds_between
from gridtide.functions.values import lenient_double
from gridtide.operators.timegrid import checked_convention, checked_instants, first_per_key, label_convention, local_day_counts, on_grid, resolve_labels
from gridtide.operators.windows import interpolated, runs

QUARTER = 900


@dataclass(frozen=True)
class CleaningSetup:
    """Parameters of clean_load."""

    tz: str = "Europe/Zurich"
    low: float = 2000.0
    high: float = 15000.0
    limit: int = 4
    long_gaps: str = "first"


def checked_header(rows: DataFrame, prefix: str, unit: str) -> DataFrame:
    """``rows`` (header, unit, …) unchanged; the job fails where the header's first line or the unit is another."""
    first = F.trim(F.split("header", "\n")[0])
    found = F.when(~first.startswith(prefix), F.concat(F.lit("unexpected header: "), first)).when(F.trim("unit") != unit, F.concat(F.lit("unexpected unit: "), F.col("unit")))
    return rows.filter(F.when(found.isNotNull(), F.raise_error(found).cast("boolean")).otherwise(F.lit(True)))


def parsed(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds energy_kwh: the text as a number, NULL where it is none."""
    return rows.withColumn("energy_kwh", lenient_double(F.col(value)))


def plausible(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def mask_implausible(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """NULL beyond the range; adds out_of_range (a missing value is never out of range)."""
    out = F.coalesce(~F.col(value).between(low, high), F.lit(False))
    return df.withColumn("out_of_range", out).withColumn(value, plausible(F.col(value), low, high))


def to_hourly(df: DataFrame, keys: list[str], value: str = "load_mw", t: str = "utc_start", need: int = 4) -> DataFrame:
    """Hourly means, missing where fewer than ``need`` of the quarters are known."""
    x = F.col(value)
    return df.groupBy(*keys, floor_to(F.col(t), 3600).alias(t)).agg(F.when(F.count(x) >= need, F.avg(x)).alias(value))


def longest_identical_run(df: DataFrame, keys: list[str], value: str, step: int, t: str = "utc_start") -> DataFrame:
    """Per series the longest run of equal known values; missing values are dropped first, an empty series has 0.

    Dropping closes the gaps, so runs are found on the positions of known values.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy(*keys, "_block").orderBy(t)
    from gridtide.operators.windows import BLOCK, _block

    known = df.filter(F.col(value).isNotNull()).withColumn("_block", _block(F.col(t), BLOCK))
    # Runs inside blocks; a run that fills a block's edge joins the next block's first run by a pass over blocks.
    new = F.coalesce(F.col(value) != F.lag(value).over(order), F.lit(True))
    marked = known.withColumn("_run", F.sum(new.cast("int")).over(order))
    pieces = marked.groupBy(*keys, "_block", "_run").agg(F.count("*").alias("n"), F.first(value).alias("v"))
    # Only a block's first and last runs can meet another block's: the inner ones are final.
    edge = Window.partitionBy(*keys, "_block")
    pieces = pieces.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(edge)))
    inner = pieces.filter("not _edge").groupBy(*keys).agg(F.max("n").alias("n"))
    chain = Window.partitionBy(*keys).orderBy("_block", "_run")  # two rows per block at most
    edges = pieces.filter("_edge").withColumn("_new", F.coalesce((F.col("v") != F.lag("v").over(chain)) | (F.col("_run") > F.lag("_run").over(chain)) & (F.col("_block") == F.lag("_block").over(chain)), F.lit(True)))
    joined = edges.withColumn("_id", F.sum(F.col("_new").cast("int")).over(chain)).groupBy(*keys, "_id").agg(F.sum("n").alias("n")).drop("_id")
    longest = joined.unionByName(inner).groupBy(*keys).agg(F.max("n").alias("longest_run"))
    return df.select(*keys).distinct().join(longest, keys, "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)).cast("long")) if keys else longest


def flatlines(df: DataFrame, keys: list[str], value: str, min_run: int, step: int = QUARTER, t: str = "utc_start") -> DataFrame:
    """Adds flatline_flag: part of a run of ``min_run`` equal values or more."""
    return runs(df, keys, value, step, t).withColumn("flatline_flag", F.col("run_size") >= min_run).drop("run_start", "run_size")


def file_report(rows: DataFrame, tz: str) -> DataFrame:
    """Per file: rows, first and last label, convention, non-numeric values, repeated labels, days with other counts.

    ``rows``: file, row_no, label, value.
    """
    per = parsed(rows).groupBy("file").agg(
        F.count("*").alias("rows"),
        F.min_by("label", "row_no").alias("first_label"),
        F.max_by("label", "row_no").alias("last_label"),
        F.count_if(F.col("energy_kwh").isNull()).alias("non_numeric"),
        (F.count("label") - F.count_distinct("label")).alias("repeated_local_labels"),
    )
    conventions = label_convention(rows).select("file", "convention")
    odd = local_day_counts(rows.join(conventions, "file"), "file", "label", F.col("convention"))
    days = odd.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("local_date").cast("string"), F.col("n"))))).alias("dst_days"))
    return per.join(conventions, "file").join(days, "file", "left")


def load_instants(rows: DataFrame, tz: str) -> DataFrame:
    """``rows`` (file, row_no, label, …) with the instant of each label, in the convention of its file.

    The job fails at a file of unknown convention and at a label that is no local time.
    """
    conventions = checked_convention(label_convention(rows)).select("file", "convention")
    return checked_instants(resolve_labels(rows.join(conventions, "file"), tz))


def clean_load(rows: DataFrame, keys: list[str], bounds: DataFrame, setup: CleaningSetup = CleaningSetup()) -> DataFrame:
    """keys, utc_start, load_mw, interpolated, observed, out_of_range on the grid of ``bounds``.

    ``rows``: keys, file, row_no, label, energy_kwh. Labels resolve to instants (load_instants), the first row of an
    instant stays, kWh per quarter become MW, implausible values and gaps become missing, and gaps are interpolated by
    the setup's limit.
    """
    instants = load_instants(rows, setup.tz)
    single = first_per_key(instants.select(*keys, "utc_start", "file", "row_no", "energy_kwh"), [*keys, "utc_start"], ["file", "row_no"])
    power = single.select(*keys, "utc_start", (F.col("energy_kwh") * 4 / 1000).alias("load_mw"), F.lit(True).alias("observed"))
    grid = on_grid(power, keys, bounds, QUARTER).withColumn("observed", F.coalesce("observed", F.lit(False)))
    return interpolated(mask_implausible(grid, "load_mw", setup.low, setup.high), keys, "load_mw", QUARTER, setup.limit, setup.long_gaps)


def validation_counts(cleaned: DataFrame, keys: list[str], instants: DataFrame | None = None) -> DataFrame:
    """Per series: expected, observed, missing, out-of-range, interpolated and remaining missing intervals, ends.

    ``instants`` (keys, utc_start before dedup) adds the duplicates.
    """
    out = cleaned.groupBy(*keys).agg(
        F.min("utc_start").alias("utc_start"),
        F.max("utc_start").alias("utc_end"),
        F.count("*").alias("expected_intervals"),
        F.count_if("observed").alias("observed_intervals"),
        F.count_if(~F.col("observed")).alias("missing_intervals"),
        F.count_if("out_of_range").alias("out_of_range_values"),
        F.count_if("interpolated").alias("interpolated_intervals"),
        F.count_if(F.col("load_mw").isNull()).alias("remaining_missing_intervals"),
    )
    if instants is None:
        return out
    twice = instants.groupBy(*keys, "utc_start").count().groupBy(*keys).agg(F.sum(F.col("count") - 1).alias("duplicate_utc_intervals"))
    return out.join(twice, keys, "left") if keys else out.crossJoin(twice)  # one row each


def validation_record(quarter: DataFrame, hourly: DataFrame, weather: DataFrame, instants: DataFrame) -> DataFrame:
    """The validation counts of one series, its duplicates, longest run of equal values, hours, and the weather's counts."""
    longest = longest_identical_run(quarter, [], "load_mw", QUARTER).select(F.col("longest_run").alias("longest_identical_run"))
    hours = hourly.agg(F.count("*").alias("hourly_rows"), F.count_if(F.col("load_mw").isNull()).alias("hourly_incomplete"))
    parts = [F.lit("rows"), F.count("*"), *[x for c in ("temperature_c", "radiation_wm2") for x in (F.lit(f"missing_{c}"), F.count_if(F.col(c).isNull()))]]
    # One row each.
    return validation_counts(quarter, [], instants).crossJoin(longest).crossJoin(hours).crossJoin(weather.agg(F.create_map(*parts).alias("weather")))
