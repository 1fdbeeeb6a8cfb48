"""Grid, cleaning and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.functions.time import floor_to, plus
from gridtide.operators import cleaning, timegrid, windows
from gridtide.plans.inputs import SERIES, TZ, event_load, load_cte, rounded, table

QUERIES, ORACLE_SQL = {}, {}
Q15 = load_cte("15 minutes")
HOURLY = load_cte("1 hour")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {HOURLY}
SELECT a.series, a.utc_start, a.load_mw, b.load_mw AS lag48h, c.load_mw AS lag168h,
       round(CASE WHEN count(a.load_mw) OVER w = 4 THEN stddev_samp(a.load_mw) OVER w END, 6) AS std4
FROM load a LEFT JOIN load b ON b.series = a.series AND b.utc_start = a.utc_start - INTERVAL 48 HOUR
LEFT JOIN load c ON c.series = a.series AND c.utc_start = a.utc_start - INTERVAL 168 HOUR
WINDOW w AS (PARTITION BY a.series ORDER BY a.utc_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def hourly_load_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 3600)
    rows = windows.rolling(load, SERIES, {"std4": ("load_mw", "std", 3, 0, 4)}, 3600)
    back = timegrid.lags(load, SERIES, "load_mw", {"lag48h": 48, "lag168h": 168})
    return rounded(rows.join(back, [*SERIES, "utc_start"], "left").select("series", "utc_start", "load_mw", "lag48h", "lag168h", "std4"))


@query(f"WITH {Q15} SELECT series, utc_start, load_mw, load_mw IS NULL AS missing FROM load")
def grid15_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir, 900).withColumn("missing", F.col("load_mw").isNull())


def _interpolation_sql(reach: str) -> str:
    return f"""WITH {Q15},
near AS (SELECT *, last_value(CASE WHEN load_mw IS NOT NULL THEN {{'t': utc_start, 'v': load_mw}} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY utc_start ROWS UNBOUNDED PRECEDING) AS p,
              first_value(CASE WHEN load_mw IS NOT NULL THEN {{'t': utc_start, 'v': load_mw}} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY utc_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM load),
f AS (SELECT *, coalesce(load_mw IS NULL AND p IS NOT NULL AND n IS NOT NULL AND {reach}, false) AS interpolated FROM near)
SELECT series, utc_start, interpolated, round(CASE WHEN interpolated THEN p.v + (n.v - p.v) * date_diff('second', p.t, utc_start) / date_diff('second', p.t, n.t) ELSE load_mw END, 6) AS load_mw FROM f"""


@query(_interpolation_sql("date_diff('second', p.t, utc_start) <= 4 * 900"))
def grid15_interpolate_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.interpolated(event_load(spark, sf_dir, 900), SERIES, "load_mw", 900, 4))


@query(_interpolation_sql("date_diff('second', p.t, n.t) <= 5 * 900"))
def grid15_interpolate_keep_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.interpolated(event_load(spark, sf_dir, 900), SERIES, "load_mw", 900, 4, "keep"))


@query(f"""WITH {Q15}, m AS (SELECT *, load_mw IS NOT NULL AS observed, coalesce(load_mw NOT BETWEEN 20 AND 200, false) AS out_of_range, CASE WHEN load_mw BETWEEN 20 AND 200 THEN load_mw END AS v FROM load),
near AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN utc_start END IGNORE NULLS) OVER (PARTITION BY series ORDER BY utc_start ROWS UNBOUNDED PRECEDING) AS p,
              first_value(CASE WHEN v IS NOT NULL THEN utc_start END IGNORE NULLS) OVER (PARTITION BY series ORDER BY utc_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM m),
f AS (SELECT *, coalesce(v IS NULL AND p IS NOT NULL AND n IS NOT NULL AND date_diff('second', p, utc_start) <= 3600, false) AS filled FROM near),
dup AS (SELECT event_type AS series, count(*) - count(DISTINCT time_bucket(INTERVAL '15 minutes', ts)) AS d FROM events GROUP BY 1)
SELECT f.series, min(utc_start) AS utc_start, max(utc_start) AS utc_end, count(*) AS expected_intervals, count_if(observed)::BIGINT AS observed_intervals, count_if(NOT observed)::BIGINT AS missing_intervals,
       count_if(out_of_range)::BIGINT AS out_of_range_values, count_if(filled)::BIGINT AS interpolated_intervals, count_if(v IS NULL AND NOT filled)::BIGINT AS remaining_missing_intervals, any_value(d)::BIGINT AS duplicate_utc_intervals
FROM f JOIN dup ON dup.series = f.series GROUP BY f.series""")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 900).withColumn("observed", F.col("load_mw").isNotNull())
    cleaned = windows.interpolated(cleaning.mask_implausible(load, "load_mw", 20.0, 200.0), SERIES, "load_mw", 900, 4)
    instants = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), floor_to(F.col("ts").cast("timestamp_ntz"), 900).alias("utc_start"))
    return cleaning.validation_counts(cleaned, SERIES, instants)


@query(f"WITH {Q15} SELECT series, date_trunc('hour', utc_start)::TIMESTAMP AS utc_start, round(CASE WHEN count(load_mw) >= 4 THEN avg(load_mw) END, 6) AS load_mw FROM load GROUP BY 1, 2")
def hourly_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.to_hourly(event_load(spark, sf_dir, 900), SERIES))


@query("""SELECT series, utc_start, event_id, user_id, value FROM (
SELECT event_type AS series, time_bucket(INTERVAL '15 minutes', ts) AS utc_start, event_id, user_id, value, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '15 minutes', ts) ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), floor_to(F.col("ts").cast("timestamp_ntz"), 900).alias("utc_start"), "event_id", "user_id", "value")
    return timegrid.first_per_key(events, [*SERIES, "utc_start"], ["event_id"])


@query("SELECT event_id, CASE WHEN value BETWEEN 5 AND 150 THEN value END AS value, coalesce(value NOT BETWEEN 5 AND 150, false) AS out_of_range FROM events")
def plausibility_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.mask_implausible(table(spark, sf_dir, "events").select("event_id", "value"), "value", 5.0, 150.0)


def _order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a labelled row: its day plus a quarter hour by its key, end labels for status O."""
    quarter = plus(F.col("o_orderdate").cast("timestamp_ntz"), (F.col("o_orderkey") % 96) * 900)
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("row_no"), F.date_format(quarter, timegrid.LABEL).alias("label"), F.when(F.col("o_orderstatus") == "O", "end").otherwise("start").alias("convention"))


@query(f"""WITH l AS (SELECT o_orderstatus AS file, o_orderkey AS row_no, o_orderdate::TIMESTAMP + INTERVAL 15 MINUTE * (o_orderkey % 96) AS local, CASE WHEN o_orderstatus = 'O' THEN 900 ELSE 0 END AS back FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY file, local ORDER BY row_no) AS occurrence FROM l),
cand AS (SELECT *, local - INTERVAL 2 HOUR AS s, local - INTERVAL 1 HOUR AS w FROM n),
v AS (SELECT *, timezone('{TZ}', timezone('UTC', s)) = local AS summer, timezone('{TZ}', timezone('UTC', w)) = local AS winter FROM cand)
SELECT file, row_no, strftime(local, '%d.%m.%Y %H:%M') AS label, occurrence::INT AS occurrence, summer OR winter AS valid,
       CASE WHEN summer AND winter THEN CASE WHEN occurrence = 1 THEN s ELSE w END WHEN summer THEN s WHEN winter THEN w END - INTERVAL 1 SECOND * back AS utc_start FROM v""")
def dst_labels_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timegrid.resolve_labels(_order_labels(spark, sf_dir), TZ).select("file", "row_no", "label", "occurrence", "valid", "utc_start")


@query(f"""WITH o AS (SELECT o_orderpriority AS file, min(o_orderdate)::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 1),
q AS (SELECT file, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS t FROM o)
SELECT file, timezone('{TZ}', timezone('UTC', t))::DATE AS local_date, count(*) AS n FROM q GROUP BY 1, 2 HAVING count(*) <> 96""")
def dst_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    grid = timegrid.spine(timegrid.own_bounds(orders, ["file"], "t"), 900, "t")
    labels = grid.select("file", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(TZ), "t"), timegrid.LABEL).alias("label"))
    return timegrid.local_day_counts(labels, "file", "label", F.lit("start"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority and year as a file of consecutive quarter-hour labels."""
    year = F.year("o_orderdate")
    n = F.row_number().over(Window.partitionBy("o_orderpriority", year).orderBy("o_orderkey"))
    start = F.when(F.col("o_orderpriority") < "3", 0).otherwise(1)
    local = plus(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz"), ((n - start) * 900).cast("long"))
    return table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", year).alias("file"), F.col("o_orderkey").alias("row_no"), F.date_format(local, timegrid.LABEL).alias("label"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"))


NUMBERED = """n AS (SELECT o_orderpriority || '/' || year(o_orderdate) AS file, o_orderkey AS row_no, o_orderkey % 7 = 0 AS bad,
make_date(year(o_orderdate), 1, 1)::TIMESTAMP + INTERVAL 15 MINUTE * (row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderkey) - CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END) AS local FROM orders)"""


@query(f"""WITH {NUMBERED}, f AS (SELECT file, strftime(arg_min(local, row_no), '%d.%m.%Y %H:%M') AS first_label FROM n GROUP BY file)
SELECT file, first_label, CASE substr(first_label, 12) WHEN '00:15' THEN 'end' WHEN '00:00' THEN 'start' END AS convention FROM f""")
def label_convention_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timegrid.label_convention(_numbered(spark, sf_dir))


@query(f"""WITH {NUMBERED} SELECT file, count(*) AS rows, strftime(arg_min(local, row_no), '%d.%m.%Y %H:%M') AS first_label, strftime(arg_max(local, row_no), '%d.%m.%Y %H:%M') AS last_label,
count_if(bad)::BIGINT AS non_numeric, count(*) - count(DISTINCT local) AS repeated_local_labels, CASE WHEN file < '3' THEN 'end' ELSE 'start' END AS convention FROM n GROUP BY file""")
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.file_report(_numbered(spark, sf_dir), TZ).drop("dst_days")


STEPS = "floor(load_mw / 50)"


@query(f"""WITH {Q15}, k AS (SELECT series, utc_start, {STEPS} AS v FROM load WHERE load_mw IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM k))
SELECT series, max(n)::BIGINT AS longest_run FROM (SELECT series, run, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY series""")
def longest_identical_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.longest_identical_run(event_load(spark, sf_dir, 900).withColumn("v", F.expr(STEPS)), SERIES, "v", 900)


@query(f"""WITH {Q15}, k AS (SELECT series, utc_start, {STEPS} AS v FROM load),
r AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM k))
SELECT series, utc_start, v::BIGINT AS v, count(*) OVER (PARTITION BY series, run) >= 3 AS flatline_flag FROM r""")
def flatline_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = event_load(spark, sf_dir, 900).select("series", "utc_start", F.expr(STEPS).cast("long").alias("v"))
    return cleaning.flatlines(steps, SERIES, "v", 3)


@query(f"""WITH {Q15}, k AS (SELECT *, lag(utc_start) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM load WHERE load_mw > 120),
r AS (SELECT *, sum(CASE WHEN date_diff('second', p, utc_start) <= 7200 + 900 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM k)
SELECT series, min(utc_start) AS start, max(utc_start) + INTERVAL 15 MINUTE AS "end", count(*) AS points FROM r GROUP BY series, run""")
def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = event_load(spark, sf_dir, 900).filter("load_mw > 120")
    return windows.flag_runs(flagged, SERIES, 7200, 900, extra=[F.count("*").alias("points")])


@query(f"""WITH {Q15}, e AS (SELECT series, utc_start AS start FROM load WHERE load_mw > 150),
c AS (SELECT a.series, a.start, count(*) AS events FROM e a JOIN e b ON b.series = a.series AND b.start >= a.start AND b.start < a.start + INTERVAL 7 DAY GROUP BY 1, 2)
SELECT series, max(events)::BIGINT AS events, arg_min(start, (-events, start)) AS start FROM c GROUP BY series""")
def densest_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.densest(event_load(spark, sf_dir, 900).filter("load_mw > 150").select("series", F.col("utc_start").alias("start")), SERIES, 7 * 86_400)


@query(f"""WITH {HOURLY}, q AS (SELECT event_id, event_type AS series, time_bucket(INTERVAL '15 minutes', ts) AS utc_start FROM events)
SELECT q.event_id, q.series, q.utc_start, coalesce(load_mw > 300, false) AS flag FROM q LEFT JOIN load h ON h.series = q.series AND h.utc_start = date_trunc('hour', q.utc_start)""")
def flag_broadcast_hour_to_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = event_load(spark, sf_dir, 3600).withColumn("flag", F.col("load_mw") > 300).select("series", "utc_start", "flag")
    points = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("series"), floor_to(F.col("ts").cast("timestamp_ntz"), 900).alias("utc_start"))
    return timegrid.spread_to_steps(hourly, SERIES, "flag", 3600, points)


@query("SELECT event_id, (props::JSON->>'k')::INT AS k, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR * i AS time, value + i AS temperature FROM events, (SELECT unnest([0, 1, 2]) AS i)")
def weather_payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.sources.payloads import hourly_rows

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    times = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.date_format(plus(F.date_trunc("hour", "ts").cast("timestamp_ntz"), i * 3600), "yyyy-MM-dd'T'HH:mm"))
    values = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("value") + i)
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct(times.alias("time"), values.alias("temperature")).alias("hourly")))
    rows = hourly_rows(events.select("event_id", payload.alias("payload"), F.get_json_object("props", "$.k").cast("int").alias("k")), "payload", ["temperature"])
    return rounded(rows.select("event_id", "k", "time", "temperature"))
