"""Anomaly queries over quarter-hour event series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import floor_to, to_local
from gridtide.operators import anomaly as A
from gridtide.operators.holidays import CalendarSetup, daily_calendar
from gridtide.operators.timegrid import lags, spread_to_steps
from gridtide.operators.windows import runs
from gridtide.plans.calendar_queries import HOLIDAYS, SHARES, WEIGHTS
from gridtide.plans.inputs import SERIES, TZ, event_load, load_cte, rounded, table
from gridtide.sources.store import kept

QUERIES, ORACLE_SQL = {}, {}
Q15, HOURLY = load_cte("15 minutes"), load_cte("1 hour")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scored_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load against the day before: actual, expected, lo, hi, score."""
    load = event_load(spark, sf_dir, 3600)
    rows = load.join(lags(load, SERIES, "load_mw", {"expected": 24}), [*SERIES, "utc_start"], "left").withColumnRenamed("load_mw", "actual")
    rows = rows.withColumns({"lo": F.col("expected") * 0.5, "hi": F.col("expected") * 1.5})
    return rows.withColumn("score", A.residual_score(F.col("actual"), F.col("lo"), F.col("hi"), 20.0))


SCORES = f"""{HOURLY}, x AS (SELECT a.series, a.utc_start, a.load_mw AS actual, b.load_mw AS expected, b.load_mw * 0.5 AS lo, b.load_mw * 1.5 AS hi FROM load a LEFT JOIN load b ON b.series = a.series AND b.utc_start = a.utc_start - INTERVAL 24 HOUR),
s AS (SELECT *, CASE WHEN actual IS NOT NULL AND lo IS NOT NULL THEN greatest(lo - actual, actual - hi, 0) / greatest(hi - lo, 20) END AS score FROM x)"""


@query(f"WITH {SCORES} SELECT series, utc_start, actual, round(expected, 6) AS expected, round(lo, 6) AS lo, round(hi, 6) AS hi, round(score, 6) AS score FROM s")
def residual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored_hours(spark, sf_dir))


@query(f"WITH {SCORES} SELECT series, round(quantile_cont(score, 0.98), 6) AS threshold FROM s GROUP BY series")
def residual_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.threshold(kept(scored_hours(spark, sf_dir), "scores"), "score", 0.02, SERIES))


LOC = f"timezone('{TZ}', timezone('UTC', {{0}}))"


@query(f"""WITH {SCORES}, k AS (SELECT *, lag(utc_start) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM s WHERE score > 0.4),
r AS (SELECT *, sum(CASE WHEN date_diff('second', p, utc_start) <= 7200 + 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM k),
sp AS (SELECT series, min(utc_start) AS start, max(utc_start) + INTERVAL 1 HOUR AS fin FROM r GROUP BY series, run),
e AS (SELECT sp.series, sp.start, sp.fin, max(score) AS max_score, avg(actual) AS mean_actual, avg(expected) AS mean_expected, avg(actual - expected) AS mean_deviation, 100 * avg((actual - expected) / nullif(expected, 0)) AS mean_deviation_pct, sum(abs(actual - expected)) AS abs_deviation
      FROM sp JOIN s ON s.series = sp.series AND s.utc_start >= sp.start AND s.utc_start < sp.fin GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(abs_deviation, 6) DESC, start) AS position FROM e)
SELECT series, start, fin AS "end", strftime({LOC.format('start')}, '%Y-%m-%d %H:%M') AS start_local, strftime({LOC.format('fin')}, '%Y-%m-%d %H:%M') AS end_local, dayname({LOC.format('start')}) AS weekday, date_diff('second', start, fin) / 3600.0 AS duration_h,
round(max_score, 6) AS max_score, round(mean_actual, 6) AS mean_actual, round(mean_expected, 6) AS mean_expected, round(mean_deviation, 6) AS mean_deviation, round(mean_deviation_pct, 6) AS mean_deviation_pct, round(abs_deviation, 6) AS abs_deviation, position::INT AS position,
CASE WHEN DATE '2024-01-01' BETWEEN {LOC.format('start')}::DATE AND {LOC.format("(fin - INTERVAL 1 HOUR)")}::DATE THEN 'New Year''s Day; ' ELSE '' END AS new_year
FROM t WHERE position <= 10""")
def event_summary_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest residual events of each series; the holidays column is reduced to its first day of the year."""
    from pyspark.sql.window import Window

    points = scored_hours(spark, sf_dir).withColumn("flag", F.coalesce(F.col("score") > 0.4, F.lit(False)))
    days = daily_calendar(spark, points.select(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(TZ), "utc_start")).alias("local_date")), CalendarSetup(WEIGHTS))
    events = A.event_summary(points, SERIES, "flag", 7200, 3600, TZ, "expected", holidays=days.select("local_date", "holiday_name"))
    position = F.row_number().over(Window.partitionBy("series").orderBy(F.desc(F.round("abs_deviation", 6)), "start"))
    new_year = F.when(F.contains("holidays", F.lit("New Year's Day")), "New Year's Day; ").otherwise("")
    return rounded(events.withColumn("position", position).filter("position <= 10").withColumn("new_year", new_year).drop("holidays"))


@query(f"""WITH {Q15}, d AS (SELECT *, load_mw - lag(load_mw) OVER w AS diff_1, lag(load_mw, 672) OVER w AS w1, lag(load_mw, 1344) OVER w AS w2, lag(load_mw, 2016) OVER w AS w3,
CASE WHEN count(load_mw) OVER q = 4 THEN stddev_samp(load_mw) OVER q END AS roll_std_1h, CASE WHEN count(load_mw) OVER m >= 5 THEN quantile_cont(load_mw, 0.5) OVER m END AS med, {LOC.format('utc_start')} AS t,
CASE WHEN load_mw = lag(load_mw) OVER w THEN 0 ELSE 1 END AS new
FROM load WINDOW w AS (PARTITION BY series ORDER BY utc_start), q AS (PARTITION BY series ORDER BY utc_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), m AS (PARTITION BY series ORDER BY utc_start ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
r AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY utc_start) AS run, list_median(list_filter([w1, w2, w3], lambda x: x IS NOT NULL)) AS ref FROM d)
SELECT series, utc_start, load_mw, round(diff_1, 6) AS diff_1, round(abs(diff_1), 6) AS abs_diff_1, round(roll_std_1h, 6) AS roll_std_1h, count(*) OVER (PARTITION BY series, run)::DOUBLE AS identical_run,
round(load_mw / nullif(ref, 0) - 1, 6) AS dev_ref_weeks, round((load_mw - med) / nullif(load_mw, 0), 6) AS dev_local_median,
round(sin(2 * pi() * (hour(t) + minute(t) / 60) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(t) + minute(t) / 60) / 24), 6) AS hour_cos, (isodow(t) >= 6)::INT AS is_weekend FROM r""")
def if_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.detector_features(event_load(spark, sf_dir, 900), SERIES, TZ))


@query(f"""WITH {SCORES}, c AS (SELECT series, hour({LOC.format('utc_start')})::INT AS hour, actual, lo, hi FROM s)
SELECT series, hour, '0.5-1.5' AS interval, 0.9::DOUBLE AS nominal, 'raw' AS variant, 0.0::DOUBLE AS margin, round(avg(coalesce(actual BETWEEN lo AND hi, false)::INT) FILTER (actual IS NOT NULL), 6) AS coverage, round(avg(hi - lo), 6) AS mean_width FROM c GROUP BY 1, 2""")
def coverage_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.operators import evaluation as E

    rows = scored_hours(spark, sf_dir).withColumnRenamed("actual", "target").withColumn("hour", F.hour(F.convert_timezone(F.lit("UTC"), F.lit(TZ), "utc_start")))
    return rounded(E.coverage(rows, {"0.5-1.5": ("lo", "hi", 0.9)}, ["series", "hour"]))


#: One injection plan for query and oracle: (kind, hours after the first, quarters, magnitude).
PLAN = [("spike", 30, 3, 0.25), ("drop", 80, 8, -0.3), ("level_shift", 150, 40, 0.12), ("flatline", 250, 16, 0.0), ("spike", 320, 1, 0.2), ("drop", 400, 5, -0.35), ("flatline", 500, 24, 0.0), ("level_shift", 600, 20, -0.1)]
PLAN_SQL = "plan(kind, h, n, magnitude) AS (VALUES " + ", ".join(f"('{k}', {h}, {n}, {m}::DOUBLE)" for k, h, n, m in PLAN) + "),\nev AS (SELECT series, kind, first + INTERVAL 1 HOUR * h AS start, first + INTERVAL 1 HOUR * h + INTERVAL 15 MINUTE * n AS fin, magnitude FROM plan, bounds, (SELECT DISTINCT series FROM load))"
SPLICED = f"""{Q15}, {PLAN_SQL},
sp AS (SELECT l.series, l.utc_start, coalesce(e.kind, '') AS label, CASE WHEN e.kind = 'flatline' THEN h.load_mw WHEN e.kind IS NOT NULL THEN l.load_mw * (1 + e.magnitude) ELSE l.load_mw END AS load_mw
       FROM load l LEFT JOIN ev e ON e.series = l.series AND l.utc_start >= e.start AND l.utc_start < e.fin LEFT JOIN load h ON h.series = e.series AND h.utc_start = e.start - INTERVAL 15 MINUTE)"""


def plan_events(spark: SparkSession, load: DataFrame) -> DataFrame:
    rules = spark.createDataFrame(PLAN, "kind string, h int, n int, magnitude double")
    first = load.groupBy("series").agg(F.min("utc_start").alias("first"))
    both = first.crossJoin(F.broadcast(rules))  # eight fixed rows for each series
    start = F.timestamp_add("HOUR", F.col("h"), F.col("first"))
    return both.select("series", "kind", start.alias("start"), F.timestamp_add("MINUTE", 15 * F.col("n"), start).alias("end"), "magnitude")


@query(f"WITH {SPLICED} SELECT series, utc_start, label, round(load_mw, 6) AS load_mw FROM sp")
def inject_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 900)
    return rounded(A.spliced(load, plan_events(spark, load), SERIES).select("series", "utc_start", "label", "load_mw"))


METHODS = {"flatline_rule": "run_size >= 4", "high": "load_mw > 110", "either": "run_size >= 4 OR load_mw > 110"}


def flagged_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Corrupted points under each method's flags, and the events per method."""
    load = event_load(spark, sf_dir, 900)
    events = plan_events(spark, load)
    points = runs(A.spliced(load, events, SERIES), SERIES, "load_mw", 900)
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(F.expr(cond), F.lit(False)).alias("flag")) for m, cond in METHODS.items()]))
    named = F.explode(F.array(*map(F.lit, METHODS))).alias("method")
    return points.withColumn("m", methods).select("series", "m.method", "utc_start", "label", "m.flag"), events.select("*", named)


DETECT = f"""{SPLICED},
rr AS (SELECT *, sum(CASE WHEN load_mw = p THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM (SELECT *, lag(load_mw) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM sp)),
rs AS (SELECT *, count(*) OVER (PARTITION BY series, run) AS run_size FROM rr),
pt AS ({' UNION ALL '.join(f"SELECT series, '{m}' AS method, utc_start, label, coalesce({c}, false) AS flag FROM rs" for m, c in METHODS.items())}),
byp AS (SELECT series, method, count_if(flag AND label <> '') AS tp, count_if(flag AND label = '') AS fp, count_if(NOT flag AND label <> '') AS fn FROM pt GROUP BY 1, 2),
hit AS (SELECT e.series, m.method, e.kind, e.start, max(CASE WHEN p.flag THEN 1 ELSE 0 END) AS hit FROM ev e CROSS JOIN (SELECT DISTINCT method FROM pt) m LEFT JOIN pt p ON p.series = e.series AND p.method = m.method AND p.utc_start >= e.start AND p.utc_start < e.fin GROUP BY 1, 2, 3, 4),
bye AS (SELECT series, method, avg(hit) AS event_recall, {', '.join(f"avg(hit) FILTER (kind = '{k}') AS event_recall_{k}" for k in A.KINDS)} FROM hit GROUP BY 1, 2),
fr AS (SELECT *, sum(CASE WHEN date_diff('second', p, utc_start) <= 7200 + 900 THEN 0 ELSE 1 END) OVER (PARTITION BY series, method ORDER BY utc_start) AS run FROM (SELECT *, lag(utc_start) OVER (PARTITION BY series, method ORDER BY utc_start) AS p FROM pt WHERE flag)),
spn AS (SELECT series, method, min(utc_start) AS start, max(utc_start) + INTERVAL 15 MINUTE AS fin FROM fr GROUP BY series, method, run),
ov AS (SELECT s.series, s.method, s.start, max(CASE WHEN p.label <> '' THEN 1 ELSE 0 END) AS good FROM spn s LEFT JOIN pt p ON p.series = s.series AND p.method = s.method AND p.utc_start >= s.start AND p.utc_start < s.fin GROUP BY 1, 2, 3),
byr AS (SELECT series, method, avg(good) AS event_precision, count(*) AS flagged_events FROM ov GROUP BY 1, 2),
dm AS (SELECT byp.series, byp.method, round(tp / nullif(tp + fp, 0), 6) AS point_precision, round(tp / nullif(tp + fn, 0), 6) AS point_recall, round(event_recall, 6) AS event_recall, {', '.join(f"round(event_recall_{k}, 6) AS event_recall_{k}" for k in A.KINDS)}, round(event_precision, 6) AS event_precision, coalesce(flagged_events, 0)::BIGINT AS flagged_events
       FROM byp LEFT JOIN bye USING (series, method) LEFT JOIN byr USING (series, method))"""


@query(f"WITH {DETECT} SELECT * FROM dm")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, events = (kept(x, n) for x, n in zip(flagged_points(spark, sf_dir), ("points", "events"), strict=True))
    return rounded(A.detection_metrics(points, events, ["series", "method"], "flag", 7200))


SUMMARY = ["point_precision", "point_recall", "event_recall", "event_precision", "flagged_events"]


@query(f"""WITH {DETECT} SELECT method, {', '.join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_samp({c}), 5) AS {c}_std" for c in SUMMARY)} FROM dm GROUP BY method""")
def detection_summary_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.detection_summary(detection_metrics(spark, sf_dir), ["method"], SUMMARY), 5)


@query(None)
def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.models import iforest

    features = kept(A.detector_features(event_load(spark, sf_dir, 900), SERIES, TZ), "detector")
    forest = iforest.fit(features, A.FEATURES, ["series", "utc_start"], trees=300, sample=2048)
    return rounded(iforest.with_score(features, forest).select("series", "utc_start", "score"))


SPEC = {
    "spike": {"min_len": 1, "max_len": 3, "min_mag": 0.25, "max_mag": 0.5},
    "drop": {"min_len": 2, "max_len": 12, "min_mag": 0.3, "max_mag": 0.6},
    "level_shift": {"min_len": 12, "max_len": 60, "min_mag": 0.1, "max_mag": 0.2},
    "flatline": {"min_len": 10, "max_len": 40},
}


SEEDS, PER_KIND = [0, 1, 2], 3
STUDY_KEYS = ["seed", "series"]
RATE = 0.02


def injected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The quarter-hour load, and per seed the corrupted points and the events spliced into every series."""
    load = kept(event_load(spark, sf_dir, 900), "load15")
    ends = load.agg(F.min("utc_start").alias("a"), F.count_distinct("utc_start").alias("n")).first()
    start = ends["a"] or datetime(2000, 1, 1)  # without events there is no series to splice into
    n = ends["n"] or 1_000_000
    plan = A.injection_plan(spark, SPEC, PER_KIND, SEEDS, start, n)
    events = kept(load.select("series").distinct().join(F.broadcast(plan)), "study-events")  # a few dozen rows for each series
    points = load.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    return load, kept(A.spliced(points, events, STUDY_KEYS), "study-points"), events


def residual_hours(load: DataFrame, keys: list[str]) -> DataFrame:
    """keys, utc_start, score: each hour's mean known load against the day before."""
    hourly = load.groupBy(*keys, floor_to(F.col("utc_start"), 3600).alias("utc_start")).agg(F.avg("load_mw").alias("load_mw"))
    rows = hourly.join(lags(hourly, keys, "load_mw", {"expected": 24}), [*keys, "utc_start"], "left")
    score = A.residual_score(F.col("load_mw"), F.col("expected") * 0.5, F.col("expected") * 1.5, 20.0)
    return rows.select(*keys, "utc_start", score.alias("score"))


def rule_flags(load: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with the flags of the residual and the flatline rule; the residual limit comes from the clean series."""
    limits = A.threshold(residual_hours(load, SERIES), "score", RATE, SERIES)
    hours = residual_hours(points, STUDY_KEYS).join(limits, SERIES).withColumn("residual", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))
    spread = spread_to_steps(hours.select(*STUDY_KEYS, "utc_start", "residual"), STUDY_KEYS, "residual", 3600, points)
    return runs(spread, STUDY_KEYS, "load_mw", 900).withColumn("flatline_rule", F.coalesce(F.col("run_size") >= 4, F.lit(False))).drop("run_start", "run_size")


def study(flags: DataFrame, events: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """Detection metrics per seed, series and method."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), flag.alias("flag")) for m, flag in methods.items()]))
    points = kept(flags.withColumn("m", each).select(*STUDY_KEYS, "m.method", "utc_start", "label", "m.flag"), "study-flags")
    named = events.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    return rounded(A.detection_metrics(points, named, [*STUDY_KEYS, "method"], "flag", 7200))


def _draw(what: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('/', seed, kind, i, '{what}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


PLAN_CTE = f"""spec(kind, a, b, c, d) AS (VALUES {", ".join(f"('{k}', {v['min_len']}, {v['max_len']}, {v.get('min_mag', 0)}::DOUBLE, {v.get('max_mag', 0)}::DOUBLE)" for k, v in SPEC.items())}),
steps AS (SELECT count(DISTINCT utc_start) AS n, min(utc_start) AS first FROM load),
dealt AS (SELECT seed, kind, i, (a + floor({_draw('length')} * (b - a + 1)))::INT AS intervals, {_draw('turn')} AS turn, {_draw('gap')} AS gap,
          CASE WHEN kind = 'flatline' THEN 0 ELSE CASE WHEN kind = 'spike' THEN 1 WHEN kind = 'drop' THEN -1 WHEN {_draw('sign')} < 0.5 THEN -1 ELSE 1 END * (c + {_draw('magnitude')} * (d - c)) END AS magnitude
          FROM (SELECT *, unnest(range(1, {PER_KIND + 1})) AS i FROM (SELECT *, unnest({SEEDS}) AS seed FROM spec))),
placed AS (SELECT *, row_number() OVER o AS nth, list_sort(list(gap) OVER (PARTITION BY seed)) AS gaps, sum(intervals + 96) OVER o - intervals AS before, (SELECT n FROM steps) - 96 - sum(intervals + 96) OVER (PARTITION BY seed) AS room
           FROM dealt WINDOW o AS (PARTITION BY seed ORDER BY turn, kind, i)),
iplan AS (SELECT seed, kind, first + INTERVAL 15 MINUTE * (before + floor(gaps[nth] * (room + 1)))::BIGINT AS start, intervals, magnitude FROM placed, steps)"""


@query(f"WITH {Q15}, {PLAN_CTE} SELECT seed::INT AS seed, kind, start, start + INTERVAL 15 MINUTE * intervals AS \"end\", intervals, round(magnitude, 6) AS magnitude FROM iplan")
def injection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, 900)
    ends = load.agg(F.min("utc_start").alias("a"), F.count_distinct("utc_start").alias("n")).first()
    return rounded(A.injection_plan(spark, SPEC, PER_KIND, SEEDS, ends["a"] or datetime(2000, 1, 1), ends["n"] or 1_000_000))


RULES_CTE = f"""{Q15}, {PLAN_CTE},
ev AS (SELECT series, seed, kind, start, start + INTERVAL 15 MINUTE * intervals AS fin, magnitude FROM iplan, (SELECT DISTINCT series FROM load)),
pts AS (SELECT series, utc_start, load_mw, unnest({SEEDS}) AS seed FROM load),
sp AS (SELECT l.seed, l.series, l.utc_start, coalesce(e.kind, '') AS label, CASE WHEN e.kind = 'flatline' THEN h.load_mw WHEN e.kind IS NOT NULL THEN l.load_mw * (1 + e.magnitude) ELSE l.load_mw END AS load_mw
       FROM pts l LEFT JOIN ev e ON e.series = l.series AND e.seed = l.seed AND l.utc_start >= e.start AND l.utc_start < e.fin LEFT JOIN load h ON h.series = e.series AND h.utc_start = e.start - INTERVAL 15 MINUTE),
hc AS (SELECT -1 AS seed, series, date_trunc('hour', utc_start) AS h, avg(load_mw) AS x FROM load GROUP BY 1, 2, 3 UNION ALL SELECT seed, series, date_trunc('hour', utc_start), avg(load_mw) FROM sp GROUP BY 1, 2, 3),
hs AS (SELECT a.seed, a.series, a.h, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN greatest(b.x * 0.5 - a.x, a.x - b.x * 1.5, 0) / greatest(b.x * 1.5 - b.x * 0.5, 20) END AS score
       FROM hc a LEFT JOIN hc b ON b.seed = a.seed AND b.series = a.series AND b.h = a.h - INTERVAL 24 HOUR),
lim AS (SELECT series, quantile_cont(score, {1 - RATE}) AS threshold FROM hs WHERE seed = -1 GROUP BY 1),
hf AS (SELECT hs.seed, hs.series, h, coalesce(score > threshold, false) AS residual FROM hs JOIN lim ON lim.series = hs.series WHERE threshold IS NOT NULL),
rr AS (SELECT *, sum(CASE WHEN load_mw = p THEN 0 ELSE 1 END) OVER (PARTITION BY seed, series ORDER BY utc_start) AS run FROM (SELECT *, lag(load_mw) OVER (PARTITION BY seed, series ORDER BY utc_start) AS p FROM sp)),
fl AS (SELECT r.seed, r.series, r.utc_start, r.label, coalesce(residual, false) AS residual, coalesce(count(*) OVER (PARTITION BY r.seed, r.series, run) >= 4, false) AS flatline_rule
       FROM rr r LEFT JOIN hf ON hf.seed = r.seed AND hf.series = r.series AND hf.h = date_trunc('hour', r.utc_start))"""
RULE_METHODS = {"residual": "residual", "flatline_rule": "flatline_rule", "residual_or_flatline": "(residual OR flatline_rule)"}
RULES_SQL = f"""WITH {RULES_CTE},
pt AS ({' UNION ALL '.join(f"SELECT seed, series, '{m}' AS method, utc_start, label, {c} AS flag FROM fl" for m, c in RULE_METHODS.items())}),
byp AS (SELECT seed, series, method, count_if(flag AND label <> '') AS tp, count_if(flag AND label = '') AS fp, count_if(NOT flag AND label <> '') AS fn FROM pt GROUP BY 1, 2, 3),
hit AS (SELECT e.seed, e.series, method, e.kind, e.start, max(flag::INT) AS hit FROM ev e JOIN pt p ON p.seed = e.seed AND p.series = e.series AND p.utc_start >= e.start AND p.utc_start < e.fin GROUP BY 1, 2, 3, 4, 5),
bye AS (SELECT seed, series, method, avg(hit) AS event_recall, {', '.join(f"avg(hit) FILTER (kind = '{k}') AS event_recall_{k}" for k in A.KINDS)} FROM hit GROUP BY 1, 2, 3),
fr AS (SELECT *, sum(CASE WHEN date_diff('second', p, utc_start) <= 7200 + 900 THEN 0 ELSE 1 END) OVER (PARTITION BY seed, series, method ORDER BY utc_start) AS run FROM (SELECT *, lag(utc_start) OVER (PARTITION BY seed, series, method ORDER BY utc_start) AS p FROM pt WHERE flag)),
spn AS (SELECT seed, series, method, min(utc_start) AS start, max(utc_start) + INTERVAL 15 MINUTE AS fin FROM fr GROUP BY seed, series, method, run),
ov AS (SELECT s.seed, s.series, s.method, s.start, max((p.label <> '')::INT) AS good FROM spn s JOIN pt p ON p.seed = s.seed AND p.series = s.series AND p.method = s.method AND p.utc_start >= s.start AND p.utc_start < s.fin GROUP BY 1, 2, 3, 4),
byr AS (SELECT seed, series, method, avg(good) AS event_precision, count(*) AS flagged_events FROM ov GROUP BY 1, 2, 3)
SELECT seed::INT AS seed, series, method, round(tp / nullif(tp + fp, 0), 6) AS point_precision, round(tp / nullif(tp + fn, 0), 6) AS point_recall, round(event_recall, 6) AS event_recall,
       {', '.join(f"round(event_recall_{k}, 6) AS event_recall_{k}" for k in A.KINDS)}, round(event_precision, 6) AS event_precision, coalesce(flagged_events, 0)::BIGINT AS flagged_events
FROM byp LEFT JOIN bye USING (seed, series, method) LEFT JOIN byr USING (seed, series, method)"""


@query(RULES_SQL)
def injection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's methods that SQL can express: residual, flatline rule and both."""
    load, points, events = injected(spark, sf_dir)
    r, f = F.col("residual"), F.col("flatline_rule")
    return study(rule_flags(load, points), events, {"residual": r, "flatline_rule": f, "residual_or_flatline": r | f})


@query(None)
def injection_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five methods over three random plans: the seed is a key through splices, residuals, features and scores.

    The forest and both limits come from the clean series.
    """
    from gridtide.models import iforest

    load, points, events = injected(spark, sf_dir)
    clean = kept(A.detector_features(load, SERIES, TZ), "detector")
    forest = iforest.fit(clean, A.FEATURES, ["series", "utc_start"], trees=100, sample=256)
    limit = A.threshold(iforest.with_score(clean, forest).select("score"), "score", RATE, [])
    corrupted = iforest.with_score(A.detector_features(points, STUDY_KEYS, TZ), forest).select(*STUDY_KEYS, "utc_start", "score")
    isolated = corrupted.crossJoin(limit).select(*STUDY_KEYS, "utc_start", (F.col("score") > F.col("threshold")).alias("isolation_forest"))  # one row
    flags = rule_flags(load, points).join(isolated, [*STUDY_KEYS, "utc_start"], "left")
    r, i, f = F.col("residual"), F.coalesce("isolation_forest", F.lit(False)), F.col("flatline_rule")
    return study(flags, events, {"residual": r, "isolation_forest": i, "flatline_rule": f, "residual_or_isolation_forest": r | i, "all_three_combined": r | i | f})


@query(f"""WITH {SCORES}, k AS (SELECT *, lag(utc_start) OVER (PARTITION BY series ORDER BY utc_start) AS p FROM s WHERE score > 0.4),
r AS (SELECT *, sum(CASE WHEN date_diff('second', p, utc_start) <= 7200 + 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY utc_start) AS run FROM k),
sp AS (SELECT series, min(utc_start) AS start, max(utc_start) + INTERVAL 1 HOUR AS fin FROM r GROUP BY series, run),
days AS (SELECT series, start, fin, unnest(generate_series({LOC.format('start')}::DATE, {LOC.format('(fin - INTERVAL 1 SECOND)')}::DATE, INTERVAL 1 DAY))::DATE AS day FROM sp),
years AS (SELECT DISTINCT unnest([year(day) - 1, year(day), year(day) + 1])::INT AS y FROM days), {HOLIDAYS}, {SHARES},
met AS (SELECT DISTINCT series, start, names FROM days JOIN names ON names.date = day)
SELECT sp.series, sp.start, sp.fin AS "end", coalesce(string_agg(names, '; ' ORDER BY names), '') AS holidays FROM sp LEFT JOIN met ON met.series = sp.series AND met.start = sp.start GROUP BY 1, 2, 3""")
def event_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residual event with all holidays of the days that it touches, in order."""
    points = scored_hours(spark, sf_dir).withColumn("flag", F.coalesce(F.col("score") > 0.4, F.lit(False)))
    points = kept(points, "scored-hours")
    days = daily_calendar(spark, points.select(F.to_date(to_local(F.col("utc_start"), TZ)).alias("local_date")), CalendarSetup(WEIGHTS))
    events = A.event_summary(points, SERIES, "flag", 7200, 3600, TZ, "expected", holidays=days.select("local_date", "holiday_name"))
    return events.select("series", "start", "end", "holidays")


@query("SELECT event_type AS series, count(*) AS points, round(quantile_cont(value, 0.5), 6) AS median_value FROM events GROUP BY 1")
def feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "series")
    return rounded(events.groupBy("series").agg(F.count("*").alias("points")).join(A.medians(events, ["value"], SERIES).withColumnRenamed("value", "median_value"), SERIES, "left"))
