"""Time series that the registered queries derive from the given tables.

``events`` (by type) are quarter-hour and hourly load series, two event types are weather stations; ``orders`` (by
priority) are daily series with two simple forecasts. Sums run over whole cents, so they are exact in any order.
Each has its DuckDB twin as a list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import floor_to, midnight, plus
from gridtide.functions.values import mean_of
from gridtide.operators.timegrid import lags, on_grid

TZ = "Europe/Zurich"
SERIES = ["series"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.sum(F.round(x * 100).cast("long")) / 100.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits``, without a negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def event_bounds(events: DataFrame, step: int) -> DataFrame:
    """Each series over the whole days of all events."""
    days = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).filter("a is not null")
    ends = days.select(midnight(F.col("a")).alias("first"), plus(midnight(F.col("b")), 86_400 - step).alias("last"))
    return events.select(F.col("event_type").alias("series")).distinct().crossJoin(F.broadcast(ends))  # one row beside a row per series


def event_load(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """series, utc_start, load_mw: the events' summed value per step; steps without an event are missing."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sums = events.groupBy(F.col("event_type").alias("series"), floor_to(F.col("ts"), step).alias("utc_start")).agg(cents(F.col("value")).alias("load_mw"))
    return on_grid(sums, SERIES, event_bounds(events, step), step)


def stations(load: DataFrame, some: bool = True) -> DataFrame:
    """location, utc_start, temperature_2m, shortwave_radiation on each hour of the hourly load: missing where a station
    has no event. ``some``: the two event types that are weather stations, else all are."""
    load = load.filter("series in ('click', 'view')") if some else load
    return load.select(F.col("series").alias("location"), "utc_start", (F.col("load_mw") / 20 - 10).alias("temperature_2m"), (F.col("load_mw") / 2).alias("shortwave_radiation"))


def station_weights(spark: SparkSession, sf_dir: str, some: bool = True) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type in ('click', 'view')" if some else "event_type is not null")
    n = events.groupBy(F.col("event_type").alias("location")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).select("location", (F.col("n") / F.col("all")).alias("weight"))  # one row


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, utc_start (a day's midnight), load_mw on every day between a series' first and last order."""
    orders = table(spark, sf_dir, "orders")
    daily = orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("utc_start")).agg(cents(F.col("o_totalprice")).alias("load_mw"))
    bounds = daily.groupBy("series").agg(F.min("utc_start").alias("first"), F.max("utc_start").alias("last"))
    return on_grid(daily, SERIES, bounds, 86_400)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, utc_start, target, naive (a week earlier), mean4 (mean of four weeks back) and quantiles of both."""
    load = daily_orders(spark, sf_dir)
    back = lags(load, SERIES, "load_mw", {f"w{k}": 168 * k for k in (1, 2, 3, 4)})
    rows = load.join(back, [*SERIES, "utc_start"], "left").select("series", "utc_start", F.col("load_mw").alias("target"), F.col("w1").alias("naive"), mean_of([F.col(f"w{k}") for k in (1, 2, 3, 4)]).alias("mean4"))
    return rows.withColumns({f"{m}_q{q}": F.col(m) * s for m in ("naive", "mean4") for q, s in (("0.05", 0.4), ("0.1", 0.6), ("0.9", 1.4), ("0.95", 1.7))})


CENTS = "sum(CAST(round({0} * 100) AS BIGINT)) / 100.0"


def load_cte(step: str) -> str:
    """raw, bounds, load of ``step`` ('15 minutes' or '1 hour')."""
    return f"""
raw AS (SELECT event_type AS series, time_bucket(INTERVAL '{step}', ts) AS utc_start, {CENTS.format("value")} AS load_mw FROM events GROUP BY 1, 2),
bounds AS (SELECT min(date_trunc('day', ts))::TIMESTAMP AS first, (max(date_trunc('day', ts)) + INTERVAL 1 DAY - INTERVAL '{step}')::TIMESTAMP AS last FROM events),
spine AS (SELECT series, unnest(generate_series(first, last, INTERVAL '{step}')) AS utc_start FROM (SELECT DISTINCT event_type AS series FROM events), bounds),
load AS (SELECT s.series, s.utc_start, r.load_mw FROM spine s LEFT JOIN raw r ON r.series = s.series AND r.utc_start = s.utc_start)"""


STATIONS_CTE = (
    load_cte("1 hour")
    + """,
stations AS (SELECT series AS location, utc_start, load_mw / 20 - 10 AS temperature_2m, load_mw / 2 AS shortwave_radiation FROM load WHERE series IN ('click', 'view')),
sw AS (SELECT event_type AS location, count(*) / sum(count(*)) OVER () AS weight FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
aligned AS (SELECT location, utc_start, (temperature_2m + lead(temperature_2m) OVER w) / 2 AS temperature_c, lead(shortwave_radiation) OVER w AS radiation_wm2
            FROM stations WINDOW w AS (PARTITION BY location ORDER BY utc_start)),
hours AS (SELECT utc_start, CASE WHEN count(temperature_c) = (SELECT count(*) FROM sw) THEN sum(temperature_c * weight) / (SELECT sum(weight) FROM sw) END AS temperature_c,
                 CASE WHEN count(radiation_wm2) = (SELECT count(*) FROM sw) THEN sum(radiation_wm2 * weight) / (SELECT sum(weight) FROM sw) END AS radiation_wm2
          FROM aligned JOIN sw USING (location) GROUP BY utc_start),
masked AS (SELECT utc_start, CASE WHEN ok THEN temperature_c END AS temperature_c, CASE WHEN ok THEN radiation_wm2 END AS radiation_wm2
           FROM (SELECT *, temperature_c BETWEEN -35 AND 45 AND radiation_wm2 BETWEEN 0 AND 1300 AS ok FROM hours WHERE temperature_c IS NOT NULL OR radiation_wm2 IS NOT NULL)),
near AS (SELECT *, last_value(CASE WHEN temperature_c IS NOT NULL THEN {'t': utc_start, 'a': temperature_c, 'b': radiation_wm2} END IGNORE NULLS) OVER (ORDER BY utc_start ROWS UNBOUNDED PRECEDING) AS p,
                first_value(CASE WHEN temperature_c IS NOT NULL THEN {'t': utc_start, 'a': temperature_c, 'b': radiation_wm2} END IGNORE NULLS) OVER (ORDER BY utc_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
         FROM masked),
weather AS (SELECT utc_start, CASE WHEN fill THEN p.a + (n.a - p.a) * f ELSE temperature_c END AS temperature_c, CASE WHEN fill THEN p.b + (n.b - p.b) * f ELSE radiation_wm2 END AS radiation_wm2
            FROM (SELECT *, temperature_c IS NULL AND p IS NOT NULL AND n IS NOT NULL AND date_diff('second', p.t, utc_start) <= 3 * 3600 AS fill,
                         date_diff('second', p.t, utc_start) / nullif(date_diff('second', p.t, n.t), 0) AS f FROM near))"""
)

PREDICTIONS_CTE = f"""
sums AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS utc_start, {CENTS.format("o_totalprice")} AS load_mw FROM orders GROUP BY 1, 2),
days AS (SELECT series, unnest(generate_series(min(utc_start), max(utc_start), INTERVAL 1 DAY)) AS utc_start FROM sums GROUP BY series),
dser AS (SELECT d.series, d.utc_start, s.load_mw FROM days d LEFT JOIN sums s ON s.series = d.series AND s.utc_start = d.utc_start),
base AS (SELECT series, utc_start, load_mw AS target, lag(load_mw, 7) OVER w AS naive, lag(load_mw, 7) OVER w AS a, lag(load_mw, 14) OVER w AS b, lag(load_mw, 21) OVER w AS c, lag(load_mw, 28) OVER w AS d
         FROM dser WINDOW w AS (PARTITION BY series ORDER BY utc_start)),
point AS (SELECT series, utc_start, target, naive, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT, 0) AS mean4 FROM base),
preds AS (SELECT *, naive * 0.4 AS "naive_q0.05", naive * 0.6 AS "naive_q0.1", naive * 1.4 AS "naive_q0.9", naive * 1.7 AS "naive_q0.95",
                 mean4 * 0.4 AS "mean4_q0.05", mean4 * 0.6 AS "mean4_q0.1", mean4 * 1.4 AS "mean4_q0.9", mean4 * 1.7 AS "mean4_q0.95" FROM point)"""
