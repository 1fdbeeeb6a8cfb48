"""Calendar queries: over the days of orders and the hours of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import easter_sunday, issue_time
from gridtide.operators import holidays as H
from gridtide.operators import weather
from gridtide.plans.inputs import TZ, event_load, load_cte, rounded, table

QUERIES, ORACLE_SQL = {}, {}
WEIGHTS = {r: 1 / len(H.REGIONS) for r in H.REGIONS} | {"ZH": 0.2, "BE": 0.15, "VD": 0.1, "GL": 0.01}
_total = sum(WEIGHTS.values())
WEIGHTS = {r: round(w / _total, 9) for r, w in WEIGHTS.items()}
SETUP = H.CalendarSetup(WEIGHTS)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# DuckDB: Easter by Gauss's table-free arithmetic on the century, holidays as a list of dates per year.
EASTER = """
ea AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
eb AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM ea),
ec AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM eb),
easter AS (SELECT y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) AS e FROM ec)"""


def _sql_list(regions: list[str]) -> str:
    return "[" + ", ".join(f"'{r}'" for r in regions) + "]"


def _quoted(name: str) -> str:
    return name.replace("'", "''")


def _on(day: str) -> str:
    m, d = day.split("-")
    return f"make_date(y, {int(m)}, {int(d)})"


_first = "make_date(y, {m}, 1)"
_nth = "make_date(y, {m}, 1) + ((({w} - isodow(make_date(y, {m}, 1))) % 7 + 7) % 7 + {k})::INT"
_rows = [f"SELECT y, '{_quoted(n)}' AS name, {_on(d)} AS date, {_sql_list(r)} AS regions FROM easter" for n, (d, r) in H.FIXED_DATES.items()]
_rows += [f"SELECT y, '{_quoted(n)}', e + ({s})::INT, {_sql_list(r)} FROM easter" for n, (s, r) in H.EASTER_DAYS.items()]
for _n, (_m, _w, _k, _after, _r) in H.WEEKDAYS.items():
    _date = _nth.format(m=_m, w=_w, k=7 * (_k - 1) + _after)
    if _n.startswith("Battle"):
        _date = f"CASE WHEN {_date} = e - 3 THEN {_date} + 7 ELSE {_date} END"
    _rows.append(f"SELECT y, '{_quoted(_n)}', {_date}, {_sql_list(_r)} FROM easter")
for _n, _cases in H.SOME_YEARS.items():
    for _r, _ref, _days in _cases:
        _rows.append(f"SELECT y, '{_quoted(_n)}', {_on(H.FIXED_DATES[_n][0])}, {_sql_list(_r)} FROM easter WHERE isodow({_on(_ref)}) IN ({', '.join(map(str, _days))})")
HOLIDAYS = EASTER + ",\nrules AS (" + "\nUNION ALL ".join(_rows) + "),\nlong AS (SELECT DISTINCT date::DATE AS date, name, unnest(regions) AS region FROM rules)"
YEARS = "years AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders)"
WIDE_YEARS = "years AS (SELECT DISTINCT unnest([year(o_orderdate) - 1, year(o_orderdate), year(o_orderdate) + 1])::INT AS y FROM orders)"
SHARES = (
    "weights(region, weight) AS (VALUES "
    + ", ".join(f"('{r}', {w}::DOUBLE)" for r, w in WEIGHTS.items())
    + "),\nshares AS (SELECT date, round(least(greatest(sum(weight), 0), 1), 6) AS share FROM (SELECT DISTINCT date, region FROM long) JOIN weights USING (region) GROUP BY date),\n"
    "names AS (SELECT date, string_agg(name, '; ' ORDER BY name) AS names FROM (SELECT DISTINCT date, name FROM long) GROUP BY date)"
)
DAILY = """
cal AS (SELECT d::DATE AS local_date, coalesce(share, 0.0) AS holiday_share, coalesce(names, '') AS holiday_name, (coalesce(share, 0) >= 0.5)::INT AS is_holiday
        FROM (SELECT unnest(generate_series(make_date(min(y), 1, 1), make_date(max(y), 12, 31), INTERVAL 1 DAY)) AS d FROM years) LEFT JOIN shares ON shares.date = d::DATE LEFT JOIN names ON names.date = d::DATE),
off AS (SELECT *, isodow(local_date) >= 6 OR is_holiday = 1 AS off FROM cal),
daily AS (SELECT local_date, holiday_share, holiday_name, is_holiday, (NOT off AND lag(off, 1, false) OVER w AND lead(off, 1, false) OVER w)::INT AS bridge_day,
                 lead(is_holiday, 1, 0) OVER w AS day_before_holiday, lag(is_holiday, 1, 0) OVER w AS day_after_holiday,
                 lag(holiday_share, 1, 0.0) OVER w AS holiday_share_prev, lead(holiday_share, 1, 0.0) OVER w AS holiday_share_next,
                 CASE WHEN isodow(local_date) = 7 OR is_holiday = 1 THEN 2 WHEN isodow(local_date) = 6 THEN 1 ELSE 0 END AS daytype
          FROM off WINDOW w AS (ORDER BY local_date))"""
SCHOOL = "(d BETWEEN e - 7 AND e + 8 OR d BETWEEN make_date(y, 7, 5) AND make_date(y, 8, 15) OR d BETWEEN make_date(y, 10, 1) AND make_date(y, 10, 20) OR d >= make_date(y, 12, 24) OR d <= make_date(y, 1, 4))::INT"


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("local_date")).agg(F.count("*").alias("orders"))


@query(f"WITH {YEARS}, {EASTER} SELECT y AS year, e::DATE AS easter, count(*) AS orders FROM orders JOIN easter ON y = year(o_orderdate) GROUP BY 1, 2")
def easter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    return years.select("year", easter_sunday(F.col("year")).alias("easter"), "orders")


@query(f"WITH {YEARS}, {HOLIDAYS} SELECT date, name, region FROM long")
def holiday_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.holidays_of(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


@query(f"WITH {YEARS}, {HOLIDAYS}, {SHARES} SELECT o_orderdate::DATE AS local_date, count(*) AS orders, coalesce(any_value(share), 0.0) AS holiday_share, coalesce(any_value(names), '') AS holiday_name FROM orders LEFT JOIN shares s ON s.date = o_orderdate::DATE LEFT JOIN names n ON n.date = o_orderdate::DATE GROUP BY 1")
def holiday_share_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(sorted(WEIGHTS.items()), "region string, weight double")
    days = order_days(spark, sf_dir)
    shares = H.share_by_day(H.holidays_of(days.select(F.year("local_date").alias("year"))), weights)
    return rounded(days.join(shares, "local_date", "left").select("local_date", "orders", F.coalesce("holiday_share", F.lit(0.0)).alias("holiday_share"), F.coalesce("holiday_name", F.lit("")).alias("holiday_name")))


@query(f"WITH {WIDE_YEARS}, {HOLIDAYS}, {SHARES}, {DAILY} SELECT daily.* FROM daily SEMI JOIN orders ON o_orderdate::DATE = local_date")
def bridge_and_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.daily_calendar(spark, order_days(spark, sf_dir), SETUP).drop("school_holiday_proxy"))


@query(f"WITH {YEARS}, {EASTER}, d AS (SELECT o_orderdate::DATE AS d, count(*) AS orders FROM orders GROUP BY 1) SELECT d AS local_date, orders, {SCHOOL} AS school_holiday_proxy FROM d JOIN easter ON y = year(d)")
def school_holiday_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_days(spark, sf_dir).withColumn("school_holiday_proxy", H.in_school_holidays(F.col("local_date")))


@query(f"""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS utc_start, count(*) AS events FROM events GROUP BY 1), l AS (SELECT *, timezone('{TZ}', timezone('UTC', utc_start)) AS t FROM h),
years AS (SELECT DISTINCT unnest([year(t) - 1, year(t), year(t) + 1])::INT AS y FROM l), {HOLIDAYS}, {SHARES}, {DAILY}
SELECT utc_start, events, t::DATE AS local_date, hour(t)::INT AS hour, (isodow(t) - 1)::INT AS weekday, month(t)::INT AS month, dayofyear(t)::INT AS day_of_year, (isodow(t) >= 6)::INT AS is_weekend,
       round(sin(2 * pi() * (dayofyear(t) - 1) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * (dayofyear(t) - 1) / 365.25), 6) AS doy_cos, daily.* EXCLUDE (local_date), {SCHOOL.replace("d ", "t::DATE ")} AS school_holiday_proxy, (hour(t) + 24 * daytype)::INT AS hour_daytype
FROM l JOIN daily ON local_date = t::DATE JOIN easter ON y = year(t)""")
def hourly_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("utc_start")).agg(F.count("*").alias("events"))
    return rounded(H.hourly_calendar(spark, hours, TZ, SETUP))


@query(f"WITH d AS (SELECT o_orderdate::DATE AS local_date, count(*) AS orders FROM orders GROUP BY 1) SELECT local_date, orders, timezone('UTC', timezone('{TZ}', local_date::TIMESTAMP - INTERVAL 14 HOUR)) AS issue_utc FROM d")
def issue_time_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_days(spark, sf_dir).withColumn("issue_utc", issue_time(F.col("local_date"), TZ, 10))


@query(f"""WITH {YEARS}, {HOLIDAYS}, kept AS (SELECT DISTINCT year(date) AS year, region, name FROM long SEMI JOIN orders ON o_orderdate::DATE = date)
SELECT 'ZH' AS of, year, name FROM (SELECT year, name FROM kept WHERE region = 'ZH' EXCEPT SELECT year, name FROM kept WHERE region = 'TI')
UNION ALL SELECT 'TI', year, name FROM (SELECT year, name FROM kept WHERE region = 'TI' EXCEPT SELECT year, name FROM kept WHERE region = 'ZH')""")
def region_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays with orders that only one of two regions keeps, both ways."""
    days = order_days(spark, sf_dir)
    kept = holiday_long(spark, sf_dir).join(days, F.col("date") == F.col("local_date"), "left_semi").select(F.year("date").alias("year"), "region", "name")

    def of(region: str) -> DataFrame:
        return kept.filter(F.col("region") == region).select("year", "name")

    return of("ZH").subtract(of("TI")).select(F.lit("ZH").alias("of"), "year", "name").unionByName(of("TI").subtract(of("ZH")).select(F.lit("TI").alias("of"), "year", "name"))


@query("""WITH p AS (SELECT n_name AS region, n_regionkey, n_nationkey, count(*) AS people FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3),
s AS (SELECT r_name AS location, region, CASE WHEN n_nationkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS share, people FROM p JOIN region ON r_regionkey = n_regionkey
      UNION ALL SELECT r_name, region, 0.5, people FROM p JOIN region ON r_regionkey = (n_regionkey + 1) % 5 WHERE n_nationkey % 5 = 0)
SELECT location, round(sum(share * people) / (SELECT sum(people) FROM p), 6) AS weight FROM s GROUP BY location""")
def location_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the world as locations, nations as the areas they stand for; every fifth nation is split in two."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("people")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region"), "people")
    split = F.col("n_nationkey") % 5 == 0
    own = nation.select("n_name", F.col("n_regionkey").alias("k"), F.when(split, 0.5).otherwise(1.0).alias("share"))
    other = nation.filter(split).select("n_name", ((F.col("n_regionkey") + 1) % 5).alias("k"), F.lit(0.5).alias("share"))
    shares = own.union(other).join(region, F.col("k") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("location")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "share"))).alias("shares"))
    return rounded(weather.location_weights(shares, people))


HOURLY = load_cte("1 hour")


@query(f"""WITH {HOURLY}, d AS (SELECT series, timezone('{TZ}', timezone('UTC', utc_start))::DATE AS local_date, avg(load_mw) AS mean FROM load GROUP BY 1, 2)
SELECT series, local_date, round(mean, 6) AS mean FROM d""")
def daily_mean_for_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(TZ), "utc_start"))
    return rounded(event_load(spark, sf_dir, 3600).groupBy("series", local.alias("local_date")).agg(F.avg("load_mw").alias("mean")))
