"""A rule-based regional holiday calendar and what forecasts derive from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import easter_sunday, midnight, nth_weekday, plus, to_local

# The regions (cantons) and which of them keep each holiday. They must equal the published calendars.
REGIONS = ("AG", "AI", "AR", "BE", "BL", "BS", "FR", "GE", "GL", "GR", "JU", "LU", "NE", "NW", "OW", "SG", "SH", "SO", "SZ", "TG", "TI", "UR", "VD", "VS", "ZG", "ZH")
MONDAYS = ("AG", "AI", "AR", "BE", "BL", "BS", "GE", "GL", "GR", "JU", "LU", "SG", "SH", "SZ", "TG", "TI", "UR", "VD", "ZH")
FIXED_DATES = {
    "New Year's Day": ("01-01", REGIONS),
    "Saint Berchtold's Day": ("01-02", ("AG", "BE", "JU", "LU", "TG", "VD")),
    "Epiphany": ("01-06", ("SZ", "TI", "UR")),
    "Republic Day": ("03-01", ["NE"]),
    "Saint Joseph's Day": ("03-19", ("NW", "SZ", "TI", "UR", "VS")),
    "Labor Day": ("05-01", ("AG", "BL", "BS", "JU", "NE", "SH", "TG", "TI", "ZH")),
    "Independence Day": ("06-23", ["JU"]),
    "Saints Peter and Paul": ("06-29", ["TI"]),
    "National Day": ("08-01", REGIONS),
    "Assumption Day": ("08-15", ("AG", "AI", "JU", "LU", "NW", "OW", "SZ", "TI", "UR", "VS", "ZG")),
    "Saint Nicholas of Flüe": ("09-25", ["OW"]),
    "All Saints' Day": ("11-01", ("AG", "AI", "GL", "JU", "LU", "NW", "OW", "SG", "SZ", "TI", "UR", "VS", "ZG")),
    "Immaculate Conception": ("12-08", ("AG", "AI", "LU", "NW", "OW", "SZ", "TI", "UR", "VS", "ZG")),
    "Christmas Day": ("12-25", REGIONS),
    "Saint Stephen's Day": ("12-26", ("AG", "BE", "BL", "BS", "GL", "GR", "LU", "SG", "SH", "SZ", "TG", "TI", "ZH")),
    "Restoration Day": ("12-31", ["GE"]),
}
EASTER_DAYS = {
    "Good Friday": (-2, [r for r in REGIONS if r not in ("GR", "TI", "VS")]),
    "Easter Monday": (1, MONDAYS),
    "Ascension Day": (39, REGIONS),
    "Pentecost Monday": (50, MONDAYS),
    "Corpus Christi": (60, ("AG", "AI", "JU", "LU", "NE", "NW", "OW", "SZ", "TI", "UR", "VS", "ZG")),
}
#: name: (month, ISO weekday, n-th, days after, regions)
WEEKDAYS = {"Genevan Fast": (9, 7, 1, 4, ["GE"]), "Prayer Monday": (9, 7, 3, 1, ["VD"]), "Battle of Naefels Victory Day": (4, 4, 1, 0, ["GL"])}
#: Regions that keep a day only in some years: (name, month-day, ISO weekday test of that day's reference date).
SOME_YEARS = {
    "Saint Stephen's Day": [(["AI", "AR", "UR"], "12-25", (2, 3, 4, 6, 7)), (["NE"], "12-25", (7,))],
    "Saint Berchtold's Day": [(["NE"], "01-01", (7,))],
}


@dataclass(frozen=True)
class Period:
    """A school-holiday window: month-days (which may cross the year's end) or days around Easter."""

    name: str
    start: str | None = None
    end: str | None = None
    easter_from: int | None = None
    easter_to: int | None = None


DEFAULT_PERIODS = [Period("spring", easter_from=-7, easter_to=8), Period("summer", "07-05", "08-15"), Period("autumn", "10-01", "10-20"), Period("christmas", "12-24", "01-04")]


@dataclass(frozen=True)
class CalendarSetup:
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    periods: tuple[Period, ...] = tuple(DEFAULT_PERIODS)


def _on(year: Column, month_day: str) -> Column:
    month, day = map(int, month_day.split("-"))
    return F.make_date(year.cast("int"), F.lit(month), F.lit(day))


def holidays_of(years: DataFrame) -> DataFrame:
    """date, name, region for every year of ``years`` (year)."""
    year = F.col("year")
    easter = easter_sunday(year)

    def rule(name: str, day: Column, regions: list[str], kept: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("name"), (F.when(kept, day) if kept is not None else day).alias("date"), F.array(*[F.lit(r) for r in regions]).alias("regions"))

    rules = [rule(name, _on(year, day), regions) for name, (day, regions) in FIXED_DATES.items()]
    rules += [rule(name, F.date_add(easter, shift), regions) for name, (shift, regions) in EASTER_DAYS.items()]
    for name, (month, weekday, n, after, regions) in WEEKDAYS.items():
        day = F.date_add(nth_weekday(year, month, weekday, n), after)
        if name.startswith("Battle"):  # not on Maundy Thursday: a week later then
            day = F.when(day == F.date_sub(easter, 3), F.date_add(day, 7)).otherwise(day)
        rules.append(rule(name, day, regions))
    for name, cases in SOME_YEARS.items():
        for regions, reference, weekdays in cases:
            rules.append(rule(name, _on(year, FIXED_DATES[name][0]), regions, (F.weekday(_on(year, reference)) + 1).isin(*weekdays)))
    each = years.select("year").distinct().select(F.explode(F.array(*rules)).alias("r")).filter("r.date is not null")
    return each.select("r.date", "r.name", F.explode("r.regions").alias("region")).distinct()


def share_by_day(holidays: DataFrame, weights: DataFrame) -> DataFrame:
    """local_date, holiday_share, holiday_name: each region's weight once a day, within 0 and 1, six digits."""
    known = holidays.join(F.broadcast(weights), "region")  # a weight per region
    shares = known.select("date", "region", "weight").distinct().groupBy("date").agg(F.sum("weight").alias("s"))
    names = known.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("holiday_name"))
    return shares.join(names, "date").select(F.col("date").alias("local_date"), F.round(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)), 6).alias("holiday_share"), "holiday_name")


def in_school_holidays(day: Column, periods: tuple[Period, ...] = tuple(DEFAULT_PERIODS)) -> Column:
    """1 inside any period: pure date arithmetic on the day's own year (and the year before, for wrapped ones)."""
    year, found = F.year(day), F.lit(False)
    for p in periods:
        if p.easter_from is not None:
            easter = easter_sunday(year)
            found = found | day.between(F.date_add(easter, p.easter_from), F.date_add(easter, p.easter_to))
        elif p.end < p.start:
            found = found | (day >= _on(year, p.start)) | (day <= _on(year, p.end))
        else:
            found = found | day.between(_on(year, p.start), _on(year, p.end))
    return found.cast("int")


def daily_calendar(spark: SparkSession, days: DataFrame, setup: CalendarSetup) -> DataFrame:
    """The calendar row of each distinct local_date of ``days``.

    Neighbour days are looked up by date, not by row, so any set of days works and no year needs padding beyond the
    two neighbours that this adds.
    """
    wanted = days.select("local_date").filter("local_date is not null").distinct()
    around = wanted.select(F.explode(F.array(F.date_sub("local_date", 1), F.col("local_date"), F.date_add("local_date", 1))).alias("local_date")).distinct()
    weights = spark.createDataFrame(sorted(setup.weights.items()), "region string, weight double")
    shares = share_by_day(holidays_of(around.select(F.year("local_date").alias("year"))), weights)
    known = around.join(shares, "local_date", "left").select("local_date", F.coalesce("holiday_share", F.lit(0.0)).alias("holiday_share"), F.coalesce("holiday_name", F.lit("")).alias("holiday_name"))
    known = known.withColumn("is_holiday", (F.col("holiday_share") >= setup.threshold).cast("int")).withColumn("_off", (F.weekday("local_date") >= 5) | (F.col("is_holiday") == 1))
    # Each day tells itself and both neighbours; one aggregation gathers them.
    told = known.select("local_date", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("_i"), F.struct("holiday_share", "is_holiday", "_off", "holiday_name").alias("_d"))
    told = told.withColumn("local_date", F.date_add("local_date", F.col("_i")))
    seen = told.groupBy("local_date").agg(*[F.max(F.when(F.col("_i") == i, F.col("_d"))).alias(n) for n, i in (("_next", -1), ("_day", 0), ("_prev", 1))]).filter("_day is not null")
    off = ~F.col("_day._off") & F.col("_prev._off") & F.col("_next._off")
    daytype = F.when((F.weekday("local_date") == 6) | (F.col("_day.is_holiday") == 1), 2).when(F.weekday("local_date") == 5, 1).otherwise(0)
    return seen.join(wanted, "local_date", "left_semi").select(
        "local_date",
        F.col("_day.holiday_share").alias("holiday_share"),
        F.col("_day.holiday_name").alias("holiday_name"),
        F.col("_day.is_holiday").alias("is_holiday"),
        off.cast("int").alias("bridge_day"),
        F.col("_next.is_holiday").alias("day_before_holiday"),
        F.col("_prev.is_holiday").alias("day_after_holiday"),
        F.col("_prev.holiday_share").alias("holiday_share_prev"),
        F.col("_next.holiday_share").alias("holiday_share_next"),
        in_school_holidays(F.col("local_date"), setup.periods).alias("school_holiday_proxy"),
        daytype.alias("daytype"),
    )


def local_parts(df: DataFrame, tz: str, t: str = "utc_start") -> DataFrame:
    """Adds local_date, hour, weekday (Monday 0), month, day_of_year, is_weekend, doy_sin, doy_cos."""
    local = to_local(F.col(t), tz)
    rows = df.withColumn("_l", local).select(*df.columns, F.to_date("_l").alias("local_date"), F.hour("_l").alias("hour"), F.weekday("_l").alias("weekday"), F.month("_l").alias("month"), F.dayofyear("_l").alias("day_of_year"))
    angle = 2 * F.pi() * (F.col("day_of_year") - 1) / 365.25
    return rows.withColumns({"is_weekend": (F.col("weekday") >= 5).cast("int"), "doy_sin": F.sin(angle), "doy_cos": F.cos(angle)})


def hourly_calendar(spark: SparkSession, df: DataFrame, tz: str, setup: CalendarSetup, t: str = "utc_start") -> DataFrame:
    """``df`` with all calendar features of each hour; the days' table is small beside the hours."""
    rows = local_parts(df, tz, t)
    daily = daily_calendar(spark, rows, setup)
    return rows.join(daily, "local_date").withColumn("hour_daytype", F.col("hour") + 24 * F.col("daytype"))


def local_midnight(utc: Column, tz: str) -> Column:
    """The local midnight at or before an instant, as local time."""
    return midnight(F.to_date(plus(to_local(utc, tz), 0)))
