"""Weather and feature queries over hourly event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.operators import features as X
from gridtide.operators import weather
from gridtide.operators.holidays import CalendarSetup
from gridtide.plans.calendar_queries import DAILY, HOLIDAYS, SCHOOL, SHARES, WEIGHTS
from gridtide.plans.inputs import SERIES, STATIONS_CTE, TZ, event_load, load_cte, rounded, station_weights, stations
from gridtide.sources.store import kept

QUERIES, ORACLE_SQL = {}, {}
SETUP = X.ForecastSetup(tz=TZ)
HOURLY = load_cte("1 hour")
LOCAL = f"timezone('{TZ}', timezone('UTC', utc_start))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def national(spark: SparkSession, sf_dir: str, load: DataFrame | None = None, some: bool = True) -> DataFrame:
    """The national weather of the two stations, or of all series, where a missing one lowers the weights."""
    load = kept(event_load(spark, sf_dir, 3600), "load") if load is None else load
    return weather.national(weather.to_interval_start(stations(load, some), ["location"]), station_weights(spark, sf_dir, some), complete=some)


def _daily(source: str, value: str, prefix: str, by: str = "series, ") -> str:
    return f"""SELECT {by}{LOCAL}::DATE AS local_date, avg({value}) AS day_mean, avg({value}) FILTER (hour({LOCAL}) < 10) AS morning_mean,
       arg_max({value}, utc_start) FILTER (hour({LOCAL}) = 9 AND {value} IS NOT NULL) AS last_known FROM {source} GROUP BY ALL"""


DAILY_LOAD = f"ref AS ({_daily('load', 'load_mw', 'load')})"
LAGS = f"""{HOURLY}, {DAILY_LOAD},
loadx AS (SELECT a.series, a.utc_start, a.load_mw AS target, {LOCAL.replace("utc_start", "a.utc_start")}::DATE AS local_date, l48.load_mw AS load_lag48h, l72.load_mw AS load_lag72h, l168.load_mw AS load_lag168h, l336.load_mw AS load_lag336h,
       (coalesce(l168.load_mw, 0) + coalesce(l336.load_mw, 0) + coalesce(l504.load_mw, 0) + coalesce(l672.load_mw, 0))
       / nullif((l168.load_mw IS NOT NULL)::INT + (l336.load_mw IS NOT NULL)::INT + (l504.load_mw IS NOT NULL)::INT + (l672.load_mw IS NOT NULL)::INT, 0) AS load_same_hour_mean_4w
FROM load a {' '.join(f"LEFT JOIN load l{h} ON l{h}.series = a.series AND l{h}.utc_start = a.utc_start - INTERVAL {h} HOUR" for h in (48, 72, 168, 336, 504, 672))}),
loadf AS (SELECT x.*, d2.day_mean AS load_dm2_mean, d1.morning_mean AS load_dm1_morning_mean, d1.last_known AS load_dm1_last, d1.morning_mean / nullif(d8.morning_mean, 0) AS load_dm1_morning_ratio_w
FROM loadx x {' '.join(f"LEFT JOIN ref d{n} ON d{n}.series = x.series AND d{n}.local_date = x.local_date - {n}" for n in (1, 2, 8))})"""
WREF = f"wref AS ({_daily('weather', 'temperature_c', 'temp', '')})"
WLAG = f"""wl AS (SELECT w.utc_start, {LOCAL.replace("utc_start", "w.utc_start")}::DATE AS local_date, a.temperature_c AS temp_lag48h, a.radiation_wm2 AS radiation_lag48h
 FROM (SELECT DISTINCT utc_start FROM load) w LEFT JOIN weather a ON a.utc_start = w.utc_start - INTERVAL 48 HOUR),
wlag AS (SELECT wl.*, d2.day_mean AS temp_dm2_mean, CASE WHEN d2.day_mean IS NOT NULL THEN greatest(16 - d2.day_mean, 0) END AS hdd_dm2, CASE WHEN d2.day_mean IS NOT NULL THEN greatest(d2.day_mean - 22, 0) END AS cdd_dm2,
 d1.morning_mean AS temp_dm1_morning_mean, d1.last_known AS temp_dm1_last FROM wl LEFT JOIN wref d1 ON d1.local_date = wl.local_date - 1 LEFT JOIN wref d2 ON d2.local_date = wl.local_date - 2)"""
WORA = f"""wgrid AS (SELECT g AS utc_start, temperature_c, radiation_wm2 FROM (SELECT unnest(generate_series(min(utc_start), max(utc_start), INTERVAL 1 HOUR)) AS g FROM weather) LEFT JOIN weather ON utc_start = g),
wroll AS (SELECT *, CASE WHEN count(temperature_c) OVER w >= 18 THEN avg(temperature_c) OVER w END AS temp_mean_24h FROM wgrid WINDOW w AS (ORDER BY utc_start ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
wora AS (SELECT i.utc_start, r.temperature_c, r.radiation_wm2, r.temp_mean_24h, d.day_mean AS temp_d_mean, CASE WHEN d.day_mean IS NOT NULL THEN greatest(16 - d.day_mean, 0) END AS hdd_d, CASE WHEN d.day_mean IS NOT NULL THEN greatest(d.day_mean - 22, 0) END AS cdd_d
 FROM (SELECT DISTINCT utc_start FROM load) i LEFT JOIN wroll r ON r.utc_start = i.utc_start LEFT JOIN wref d ON d.local_date = {LOCAL.replace("utc_start", "i.utc_start")}::DATE)"""


def _round(names: list[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


@query(f"WITH {HOURLY}, {DAILY_LOAD} SELECT series, local_date, {_round(['day_mean', 'morning_mean', 'last_known'])} FROM ref")
def daily_reference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.daily_reference(event_load(spark, sf_dir, 3600), SERIES, "load_mw", SETUP))


@query(f"WITH {LAGS} SELECT series, utc_start, round(load_same_hour_mean_4w, 6) AS load_same_hour_mean_4w FROM loadf")
def same_hour_mean_4w(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 3600)
    return rounded(X.load_lag_features(load.select("series", "utc_start"), load, SERIES, SETUP).select("series", "utc_start", "load_same_hour_mean_4w"))


@query(f"WITH {LAGS} SELECT series, utc_start, local_date, {_round(X.lag_names(SETUP))} FROM loadf")
def load_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 3600)
    return rounded(X.load_lag_features(load.select("series", "utc_start"), load, SERIES, SETUP))


@query(f"WITH {STATIONS_CTE} SELECT utc_start, {_round(['temperature_c', 'radiation_wm2'])} FROM weather")
def national_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(national(spark, sf_dir))


ALL_STATIONS_CTE = STATIONS_CTE.replace(" WHERE series IN ('click', 'view')", "").replace(" WHERE event_type IN ('click', 'view')", " WHERE event_type IS NOT NULL")
for _c in ("temperature_c", "radiation_wm2"):
    _whole = f"CASE WHEN count({_c}) = (SELECT count(*) FROM sw) THEN sum({_c} * weight) / (SELECT sum(weight) FROM sw) END"
    ALL_STATIONS_CTE = ALL_STATIONS_CTE.replace(_whole, f"sum({_c} * weight) / sum(weight) FILTER ({_c} IS NOT NULL)")


@query(f"WITH {ALL_STATIONS_CTE} SELECT utc_start, round(temperature_c + 1e-9, 6) AS temperature_c, round(radiation_wm2 + 1e-9, 6) AS radiation_wm2 FROM weather")
def national_weather_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type is a station; an hour without one of them has the weighted mean of the others.

    Means of whole cents with weights of few digits often end in a 5 at the seventh digit: a little is added, so that
    both engines round these up whatever the order of their sums.
    """
    found = national(spark, sf_dir, some=False)
    return rounded(found.select("utc_start", *[(F.col(c) + 1e-9).alias(c) for c in ("temperature_c", "radiation_wm2")]))


@query(f"WITH {STATIONS_CTE}, {WREF}, {WLAG} SELECT utc_start, local_date, {_round(X.LAGGED_WEATHER)} FROM wlag")
def lagged_weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = event_load(spark, sf_dir, 3600).select("utc_start").distinct()
    return rounded(X.lagged_weather_features(index, national(spark, sf_dir), SETUP))


@query(f"WITH {STATIONS_CTE}, {WREF}, {WORA} SELECT utc_start, {_round(X.ORACLE_WEATHER)} FROM wora")
def oracle_weather_rolling24(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = event_load(spark, sf_dir, 3600).select("utc_start").distinct()
    return rounded(X.oracle_weather_features(index, national(spark, sf_dir), SETUP).drop("local_date"))




@query(f"""WITH {LAGS}, {STATIONS_CTE[len(HOURLY) + 1:]}, {WREF}, {WLAG}, {WORA},
years AS (SELECT DISTINCT unnest([year(local_date) - 1, year(local_date), year(local_date) + 1])::INT AS y FROM loadf), {HOLIDAYS}, {SHARES}, {DAILY},
t AS (SELECT f.*, {LOCAL.replace("utc_start", "f.utc_start")} AS t FROM loadf f)
SELECT t.series, t.utc_start, t.local_date, t.target, hour(t)::INT AS hour, (isodow(t) - 1)::INT AS weekday, month(t)::INT AS month, dayofyear(t)::INT AS day_of_year, (isodow(t) >= 6)::INT AS is_weekend,
round(sin(2 * pi() * (dayofyear(t) - 1) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * (dayofyear(t) - 1) / 365.25), 6) AS doy_cos, daily.* EXCLUDE (local_date), {SCHOOL.replace("d ", "t.local_date ")} AS school_holiday_proxy, (hour(t) + 24 * daytype)::INT AS hour_daytype,
{_round(X.lag_names(SETUP), 't.')}, {_round(X.LAGGED_WEATHER, 'wlag.')}, {_round(X.ORACLE_WEATHER, 'wora.')}, timezone('UTC', timezone('{TZ}', t.local_date::TIMESTAMP - INTERVAL 14 HOUR)) AS issue_time_utc
FROM t JOIN daily ON daily.local_date = t.local_date JOIN easter ON y = year(t.local_date) JOIN wlag ON wlag.utc_start = t.utc_start JOIN wora ON wora.utc_start = t.utc_start""")
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = kept(event_load(spark, sf_dir, 3600), "load")
    return rounded(X.feature_frame(spark, load, load, kept(national(spark, sf_dir, load), "weather"), SERIES, SETUP, CalendarSetup(WEIGHTS)))


@query(f"""WITH {HOURLY}, h AS (SELECT series, utc_start, {LOCAL}::DATE AS local_date FROM load)
SELECT series, local_date, count(*) AS hours, 0::BIGINT AS changed,
       count_if(utc_start - INTERVAL 24 HOUR >= timezone('UTC', timezone('{TZ}', local_date::TIMESTAMP - INTERVAL 14 HOUR)) AND utc_start - INTERVAL 24 HOUR >= (SELECT first FROM bounds)) AS control_changed
FROM h GROUP BY 1, 2""")
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load features of every day against a series spoilt after issue time; a lag of 24 hours is the leaking control."""
    from gridtide.operators.timegrid import lags

    load = kept(event_load(spark, sf_dir, 3600), "load")

    def safe(index: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
        return X.load_lag_features(index, load, keys, SETUP)

    def leaking(index: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
        return index.join(lags(load, keys, "load_mw", {"lag24h": 24}), [*keys, "utc_start"], "left")

    found = X.leakage_check(safe, load, SERIES, SETUP)
    control = X.leakage_check(leaking, load, SERIES, SETUP).withColumnRenamed("changed", "control_changed")
    return found.join(control.drop("hours"), [*SERIES, "local_date"])
