"""Leakage-safe features for day-ahead forecasts of hourly series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import issue_time, to_local
from gridtide.functions.values import at_least_zero, mean_of
from gridtide.operators.holidays import CalendarSetup, hourly_calendar
from gridtide.operators.timegrid import lags, regular
from gridtide.operators.windows import rolling

HOUR = 3600
#: The published names of the features, by set.
CALENDAR = ("hour", "weekday", "month", "day_of_year", "doy_sin", "doy_cos", "is_weekend", "holiday_share", "is_holiday", "bridge_day", "day_before_holiday", "day_after_holiday", "holiday_share_prev", "holiday_share_next", "school_holiday_proxy", "daytype")
LAGGED_WEATHER = ("temp_lag48h", "radiation_lag48h", "temp_dm2_mean", "hdd_dm2", "cdd_dm2", "temp_dm1_morning_mean", "temp_dm1_last")
ORACLE_WEATHER = ("temperature_c", "radiation_wm2", "temp_d_mean", "hdd_d", "cdd_d", "temp_mean_24h")


@dataclass(frozen=True)
class ForecastSetup:
    """What is known when: a forecast for day D is issued on D-1 at issue_hour, local time."""

    tz: str = "Europe/Zurich"
    issue_hour: int = 10
    lag_hours: tuple[int, ...] = (48, 72, 168, 336)
    weekly_mean_weeks: int = 4
    heat_base: float = 16.0
    cool_base: float = 22.0

    @property
    def horizon_hours(self) -> int:
        """From issue to the last hour of the target day, the 25-hour day included."""
        return 24 + (24 - self.issue_hour) + 1

    def __post_init__(self) -> None:
        if not 1 <= self.issue_hour <= 23:
            raise ValueError("the issue hour is within 1 and 23")
        short = [h for h in self.lag_hours if h <= self.horizon_hours]
        if short:
            raise ValueError(f"lags {short} reach into the hours after issue (horizon {self.horizon_hours})")


def lag_names(setup: ForecastSetup) -> list[str]:
    return [*(f"load_lag{h}h" for h in setup.lag_hours), f"load_same_hour_mean_{setup.weekly_mean_weeks}w", "load_dm2_mean", "load_dm1_morning_mean", "load_dm1_last", "load_dm1_morning_ratio_w"]


def feature_sets(setup: ForecastSetup) -> dict[str, list[str]]:
    base = [*CALENDAR, *lag_names(setup)]
    return {"calendar": CALENDAR, "no_weather": base, "lagged_weather": [*base, *LAGGED_WEATHER], "oracle_weather": [*base, *LAGGED_WEATHER, *ORACLE_WEATHER]}


def daily_reference(hourly: DataFrame, keys: list[str], value: str, setup: ForecastSetup, t: str = "utc_start") -> DataFrame:
    """keys, local_date, day_mean, morning_mean, last_known: one aggregation by local day.

    morning: hours before issue; last_known: the last known value of the hour just before issue.
    """
    local, x = to_local(F.col(t), setup.tz), F.col(value)
    hour = F.hour(local)
    before = F.when(hour == setup.issue_hour - 1, x)
    return hourly.groupBy(*keys, F.to_date(local).alias("local_date")).agg(F.avg(x).alias("day_mean"), F.avg(F.when(hour < setup.issue_hour, x)).alias("morning_mean"), F.max_by(before, F.when(before.isNotNull(), F.col(t))).alias("last_known"))


def shifted_days(daily: DataFrame, keys: list[str], names: dict[str, tuple[str, int]]) -> DataFrame:
    """Daily values ``n`` calendar days later: name -> (column, days); one aggregation over the sent copies."""
    sent = daily.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in sorted({n for _, n in names.values()})]))).withColumn("local_date", F.date_add("local_date", F.col("_n")))
    return sent.groupBy(*keys, "local_date").agg(*[F.max(F.when(F.col("_n") == n, F.col(c))).alias(name) for name, (c, n) in names.items()])


def _with_local_date(index: DataFrame, setup: ForecastSetup, t: str) -> DataFrame:
    return index if "local_date" in index.columns else index.withColumn("local_date", F.to_date(to_local(F.col(t), setup.tz)))


def load_lag_features(index: DataFrame, load: DataFrame, keys: list[str], setup: ForecastSetup, value: str = "load_mw", t: str = "utc_start") -> DataFrame:
    """``index`` (keys, utc_start) with the load's lags, same-hour mean and daily references."""
    weeks = {f"_w{w}": 168 * w for w in range(1, setup.weekly_mean_weeks + 1)}
    back = lags(load, keys, value, {f"load_lag{h}h": h for h in setup.lag_hours} | weeks, t)
    rows = _with_local_date(index, setup, t).join(back, [*keys, t], "left")
    rows = rows.withColumn(f"load_same_hour_mean_{setup.weekly_mean_weeks}w", mean_of([F.col(w) for w in weeks])).drop(*weeks)
    names = {"load_dm2_mean": ("day_mean", 2), "load_dm1_morning_mean": ("morning_mean", 1), "load_dm1_last": ("last_known", 1), "_dm8": ("morning_mean", 8)}
    rows = rows.join(shifted_days(daily_reference(load, keys, value, setup, t), keys, names), [*keys, "local_date"], "left")
    return rows.withColumn("load_dm1_morning_ratio_w", F.try_divide(F.col("load_dm1_morning_mean"), F.col("_dm8"))).drop("_dm8")


def degree_days(mean: Column, heat: float, cool: float) -> tuple[Column, Column]:
    return at_least_zero(F.lit(heat) - mean), at_least_zero(mean - cool)


def lagged_weather_features(index: DataFrame, weather: DataFrame, setup: ForecastSetup, t: str = "utc_start") -> DataFrame:
    """``index`` with the weather that is known at issue; weather: utc_start, temperature_c, radiation_wm2."""
    temp, rad = (lags(weather, [], c, {n: 48}, t) for c, n in (("temperature_c", "temp_lag48h"), ("radiation_wm2", "radiation_lag48h")))
    names = {"temp_dm2_mean": ("day_mean", 2), "temp_dm1_morning_mean": ("morning_mean", 1), "temp_dm1_last": ("last_known", 1)}
    days = shifted_days(daily_reference(weather, [], "temperature_c", setup, t), [], names)
    rows = _with_local_date(index, setup, t).join(temp, t, "left").join(rad, t, "left").join(days, "local_date", "left")
    hdd, cdd = degree_days(F.col("temp_dm2_mean"), setup.heat_base, setup.cool_base)
    return rows.withColumn("hdd_dm2", hdd).withColumn("cdd_dm2", cdd)


def oracle_weather_features(index: DataFrame, weather: DataFrame, setup: ForecastSetup, t: str = "utc_start") -> DataFrame:
    """``index`` with the target hour's own weather (an upper bound for any weather forecast)."""
    grid = rolling(regular(weather, [], HOUR, t), [], {"temp_mean_24h": ("temperature_c", "mean", 23, 0, 18)}, HOUR, t)
    days = daily_reference(weather, [], "temperature_c", setup, t).select("local_date", F.col("day_mean").alias("temp_d_mean"))
    rows = _with_local_date(index, setup, t).join(grid.select(t, "temperature_c", "radiation_wm2", "temp_mean_24h"), t, "left").join(days, "local_date", "left")
    hdd, cdd = degree_days(F.col("temp_d_mean"), setup.heat_base, setup.cool_base)
    return rows.withColumn("hdd_d", hdd).withColumn("cdd_d", cdd)


def feature_frame(spark: SparkSession, index: DataFrame, load: DataFrame, weather: DataFrame, keys: list[str], setup: ForecastSetup, calendar: CalendarSetup, value: str = "load_mw", t: str = "utc_start") -> DataFrame:
    """All features, the target and the issue time of every (keys, utc_start) of ``index``."""
    frame = hourly_calendar(spark, index.select(*keys, t), setup.tz, calendar, t)
    frame = load_lag_features(frame, load, keys, setup, value, t)
    frame = oracle_weather_features(lagged_weather_features(frame, weather, setup, t), weather, setup, t)
    target = load.select(*keys, t, F.col(value).alias("target"))
    return frame.join(target, [*keys, t], "left").withColumn("issue_time_utc", issue_time(F.col("local_date"), setup.tz, setup.issue_hour))


def leakage_check(make: Callable[[DataFrame, DataFrame, list[str]], DataFrame], load: DataFrame, keys: list[str], setup: ForecastSetup, value: str = "load_mw", t: str = "utc_start", spacing: int = 35) -> DataFrame:
    """keys, local_date, hours, changed: hours of a day whose features depend on what its forecast cannot know.

    ``make(index, load, keys)`` are the features. Every ``spacing``-th day shares a case: a copy of the series in which
    all values from those days' issue times to their ends are overwritten. A day's features from its case are compared
    by hash with those of the true series, so all days are checked in one job of ``spacing`` + 1 copies. ``spacing``
    is more days than the features look back.
    """
    local = F.to_date(to_local(F.col(t), setup.tz))
    day = F.datediff(local, F.lit("1970-01-01"))
    index = load.select(*keys, t).withColumn("_case", F.pmod(day, F.lit(spacing)))
    copies = load.select(*keys, t, value).withColumn("_case", F.explode(F.sequence(F.lit(0), F.lit(spacing - 1))))
    own = F.pmod(day, F.lit(spacing)) == F.col("_case")
    following = (F.pmod(day + 1, F.lit(spacing)) == F.col("_case")) & (F.col(t) >= issue_time(F.date_add(local, 1), setup.tz, setup.issue_hour))
    spoilt = copies.withColumn(value, F.when(own | following, F.lit(1e9)).otherwise(F.col(value)))

    def hashed(features: DataFrame, name: str) -> DataFrame:
        made = [c for c in features.columns if c not in (*keys, t, "_case", "local_date")]
        return features.select(*keys, t, F.xxhash64(*made).alias(name))

    seen = hashed(make(index, spoilt, [*keys, "_case"]), "_spoilt")
    both = hashed(make(load.select(*keys, t), load, keys), "_true").join(seen, [*keys, t])
    changed = F.count_if(F.col("_true") != F.col("_spoilt"))
    return both.groupBy(*keys, local.alias("local_date")).agg(F.count("*").alias("hours"), changed.alias("changed"))
