"""Behaviour of the operators on small hand-made series."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridtide.functions.time import easter_sunday, issue_time
from gridtide.functions.values import median_of
from gridtide.operators import anomaly, cleaning, evaluation, features, holidays, timegrid, windows
from gridtide.operators.ranges import in_spans

TZ = "Europe/Zurich"
START = datetime(2024, 1, 1)


def series(spark, values, step=900, start=START):
    rows = [("s", start + timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, utc_start timestamp_ntz, x double")


def column(df, name, order="utc_start"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


@pytest.mark.parametrize("convention", ["start", "end"])
@pytest.mark.parametrize(("day", "rows"), [(date(2024, 3, 31), 92), (date(2024, 10, 27), 100)])
def test_labels_of_clock_change_days(spark, convention, day, rows):
    """Local labels of a 23- or 25-hour day resolve to consecutive instants, in file order."""
    first = datetime(day.year, day.month, day.day) - timedelta(hours=1 if day.month == 3 else 2)
    instants = spark.createDataFrame([(i, first + timedelta(minutes=15 * i)) for i in range(rows)], "row_no int, utc timestamp_ntz")
    shown = instants.withColumn("l", F.expr(f"utc + interval '{15 if convention == 'end' else 0}' minute"))
    labels = shown.select(F.lit("f").alias("file"), "row_no", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(TZ), "l"), timegrid.LABEL).alias("label"), F.lit(convention).alias("convention"), "utc")
    got = timegrid.resolve_labels(labels, TZ).orderBy("row_no").collect()
    assert all(r["valid"] and r["utc_start"] == r["utc"] for r in got)


def test_skipped_label_is_invalid(spark):
    rows = spark.createDataFrame([("f", 1, "31.03.2024 02:15", "start"), ("f", 2, None, "start")], "file string, row_no int, label string, convention string")
    assert [(r["valid"], r["utc_start"]) for r in timegrid.resolve_labels(rows, TZ).orderBy("row_no").collect()] == [(False, None), (False, None)]


def test_label_convention(spark):
    rows = spark.createDataFrame([("a", 3, "01.01.2024 00:15"), ("b", 3, "01.01.2025 00:00"), ("c", 3, "01.01.2025 00:30")], "file string, row_no int, label string")
    assert dict(timegrid.label_convention(rows).select("file", "convention").collect()) == {"a": "end", "b": "start", "c": None}


def test_hourly_needs_all_quarters(spark):
    df = series(spark, [1, 2, 3, 4, 5, None, 7, 8]).withColumnRenamed("x", "load_mw")
    assert column(cleaning.to_hourly(df, ["series"]), "load_mw") == [2.5, None]


@pytest.mark.parametrize("span", [windows.BLOCK, 1800])
def test_interpolation_limits(spark, span):
    """Blocks of two rows give what one block gives."""
    df = series(spark, [1, None, 3, None, None, None, None, None, 9, None])
    first = column(windows.interpolated(df, ["series"], "x", 900, 4, "first", span=span), "x")
    assert first == [1, 2, 3, 4, 5, 6, 7, None, 9, None]
    keep = column(windows.interpolated(df, ["series"], "x", 900, 4, "keep", span=span), "x")
    assert keep == [1, 2, 3, None, None, None, None, None, 9, None]


@pytest.mark.parametrize("span", [windows.BLOCK, 1800])
def test_runs_and_missing_values(spark, span):
    df = series(spark, [1, 1, 2, 2, 2, None, None, 3])
    assert column(windows.runs(df, ["series"], "x", 900, span=span), "run_size") == [2, 2, 3, 3, 3, 1, 1, 1]


def test_longest_run(spark):
    assert cleaning.longest_identical_run(series(spark, [1, 1, 2, 2, None, 2, 3]), ["series"], "x", 900).first()["longest_run"] == 3
    assert cleaning.longest_identical_run(series(spark, [None, None]), ["series"], "x", 900).first()["longest_run"] == 0


def test_rolling_guards(spark):
    df = windows.rolling(series(spark, [1, 2, None, 4, 5, 6, 7]), ["series"], {"std": ("x", "std", 3, 0, 4), "mean": ("x", "mean", 1, 0, 1), "med": ("x", "median", 4, 4, 5)}, 900, span=1800)
    assert [v is None for v in column(df, "std")] == [True] * 6 + [False]
    assert column(df, "med")[:3] == [None, 4.0, 4.5]
    assert column(df, "mean")[:3] == [1.0, 1.5, 2.0]


def test_flag_runs_merge_at_the_gap(spark):
    df = series(spark, [1 if i in (2, 3, 5, 20) else 0 for i in range(48)], 3600).filter("x = 1")
    got = [((r["start"] - START) // timedelta(hours=1), (r["end"] - START) // timedelta(hours=1)) for r in windows.flag_runs(df, ["series"], 7200, 3600).orderBy("start").collect()]
    assert got == [(2, 6), (20, 21)]


def test_lags_are_hours_not_rows(spark):
    df = series(spark, [0, 1, 2, 3], 3600).filter("x <> 1")
    got = timegrid.lags(df, ["series"], "x", {"a": 1, "b": 2})
    at = {r["utc_start"].hour: (r["a"], r["b"]) for r in got.collect()}
    assert at[2] == (None, 0.0) and at[3] == (2.0, None)


def test_range_join_is_half_open(spark):
    spans = spark.createDataFrame([("s", START, START + timedelta(hours=1), "k"), ("s", START, START, "empty")], "series string, start timestamp_ntz, end timestamp_ntz, kind string")
    assert in_spans(series(spark, range(8)), spans, ["series"], 600).count() == 4


def test_holidays_known_days(spark):
    days = ["2024-03-29", "2024-08-01", "2024-12-26", "2024-05-10", "2024-07-15", "2024-02-14"]
    frame = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("local_date"))
    setup = holidays.CalendarSetup({"ZH": 0.5, "GE": 0.3, "TI": 0.2})
    got = {str(r["local_date"]): r for r in holidays.daily_calendar(spark, frame, setup).collect()}
    assert got["2024-03-29"]["holiday_share"] == 0.8 and got["2024-03-29"]["is_holiday"] == 1
    assert got["2024-08-01"]["holiday_share"] == 1.0 and got["2024-12-26"]["holiday_share"] == 0.7
    assert got["2024-05-10"]["bridge_day"] == 1 and got["2024-05-10"]["day_after_holiday"] == 1
    assert got["2024-07-15"]["school_holiday_proxy"] == 1 and got["2024-02-14"]["school_holiday_proxy"] == 0


def test_easter(spark):
    years = spark.createDataFrame([(2021,), (2024,), (2025,), (1954,), (2049,)], "y int").select("y", easter_sunday(F.col("y")))
    assert {y: str(d) for y, d in years.collect()} == {2021: "2021-04-04", 2024: "2024-03-31", 2025: "2025-04-20", 1954: "1954-04-18", 2049: "2049-04-18"}


#: The published public holidays of 2024 in three cantons.
PUBLISHED = {
    "ZH": ("01-01", "03-29", "04-01", "05-01", "05-09", "05-20", "08-01", "12-25", "12-26"),
    "GE": ("01-01", "03-29", "04-01", "05-09", "05-20", "08-01", "09-05", "12-25", "12-31"),
    "TI": ("01-01", "01-06", "03-19", "04-01", "05-01", "05-09", "05-20", "05-30", "06-29", "08-01", "08-15", "11-01", "12-08", "12-25", "12-26"),
}


def test_holidays_equal_published_days(spark):
    found = holidays.holidays_of(spark.createDataFrame([(2024,)], "year int")).collect()
    for region, days in PUBLISHED.items():
        assert sorted(str(r["date"])[5:] for r in found if r["region"] == region) == list(days), region


def test_labels_that_are_none_fail(spark):
    from gridtide.operators import cleaning

    def rows(*labels):
        return spark.createDataFrame([("f", i, x, 1.0) for i, x in enumerate(labels)], "file string, row_no int, label string, energy_kwh double")

    assert cleaning.load_instants(rows("01.01.2024 00:15", "31.03.2024 03:00"), "Europe/Zurich").count() == 2
    with pytest.raises(Exception, match="unknown label convention in f: 01.01.2024 00:30"):
        cleaning.load_instants(rows("01.01.2024 00:30"), "Europe/Zurich").count()
    for label in ("31.03.2024 02:30", "32.01.2024 00:00", None):
        with pytest.raises(Exception, match="no such local time|could not be parsed"):
            cleaning.load_instants(rows("01.01.2024 00:00", label), "Europe/Zurich").count()


@pytest.mark.parametrize("few", [65_536, 20])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_order_statistics_are_exact(spark, monkeypatch, by, few):
    import numpy as np

    from gridtide.operators import order_stats

    monkeypatch.setattr(order_stats, "FEW", few)  # 20: narrowed again and again

    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else g, None if rng.random() < 0.05 else float(rng.choice([rng.normal(), 1.5, rng.integers(5)]))) for g in (0, 1, 2) for _ in range(3000 if g else 7)]
    df = spark.createDataFrame(rows, "g int, x double")
    from gridtide.operators.order_stats import quantile, ranked

    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g if by else "all", []).append(x)
    for q in (0, 0.5, 0.97, 1):
        got = {(r["g"] if by else "all"): r["m"] for r in quantile(df, by, "x", q, "m").collect()}
        assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in groups.items()})
    got = {(r["g"] if by else "all"): (r["n"], r["values"]) for r in ranked(df, by, "x", lambda n: [F.lit(3), n]).collect()}
    assert got == {g: (len(v), [sorted(v)[2], max(v)]) for g, v in groups.items()}
    assert quantile(df.limit(0), by, "x", 0.5, "m").count() == 0


def test_issue_time(spark):
    days = [("2024-03-31", datetime(2024, 3, 30, 9)), ("2024-04-01", datetime(2024, 3, 31, 8)), ("2024-10-27", datetime(2024, 10, 26, 8)), ("2024-10-28", datetime(2024, 10, 27, 9))]
    got = spark.createDataFrame(days, "d string, t timestamp_ntz").select("t", issue_time(F.to_date("d"), TZ, 10).alias("i")).collect()
    assert all(r["t"] == r["i"] for r in got)


def test_short_lags_are_refused():
    with pytest.raises(ValueError, match="24"):
        features.ForecastSetup(lag_hours=(24, 168))


def test_features_know_nothing_after_issue(spark):
    """Values from the issue time on are replaced by a billion: the target day's features must stay."""
    day, setup = date(2024, 3, 31), features.ForecastSetup()
    hours = [("s", datetime(2024, 2, 20) + timedelta(hours=i), 6000.0 + (i * 37) % 500) for i in range(24 * 45)]
    load = spark.createDataFrame(hours, "series string, utc_start timestamp_ntz, load_mw double")
    issue = datetime(2024, 3, 30, 9)
    wrong = load.withColumn("load_mw", F.when(F.col("utc_start") >= F.lit(issue), 1e9).otherwise(F.col("load_mw")))

    def of(frame):
        made = features.load_lag_features(load.select("series", "utc_start"), frame, ["series"], setup)
        return made.filter(F.col("local_date") == F.lit(day)).orderBy("utc_start").collect()

    assert of(load) == of(wrong) and len(of(load)) == 23


def test_metrics_and_margin(spark):
    df = spark.createDataFrame([("s", 2.0, 1.0), ("s", None, 1.0), ("s", 4.0, 5.0)], "series string, target double, m double")
    r = evaluation.metrics(df, ["m"], ["series"]).first()
    assert (r["mae"], r["rmse"], r["n_hours"]) == (1.0, 1.0, 2) and r["mape_pct"] == pytest.approx(37.5)
    scores = spark.createDataFrame([("s", float(i), 0.0, 0.0) for i in range(1, 100)], "series string, target double, lo double, hi double")
    assert evaluation.conformal_margin(scores, "lo", "hi", 0.9, ["series"]).first()["margin"] == 91.0


def test_row_median(spark):
    df = spark.createDataFrame([(3.0, None, 1.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(median_of([F.col(c) for c in "abc"])).collect()] == [2.0, None]


def test_residual_score(spark):
    df = spark.createDataFrame([(5.0, 4.0, 6.0), (10.0, 4.0, 6.0), (0.0, 4.0, 6.0), (None, 4.0, 6.0)], "y double, lo double, hi double")
    assert [r[0] for r in df.select(anomaly.residual_score(F.col("y"), F.col("lo"), F.col("hi"), 1.0)).collect()] == [0.0, 2.0, 2.0, None]


def test_perfect_detector(spark):
    load = series(spark, [6000 + (i * 7919) % 97 for i in range(96 * 60)]).withColumnRenamed("x", "load_mw")
    spec = {"spike": {"min_len": 2, "max_len": 5, "min_mag": 0.2, "max_mag": 0.5}, "drop": {"min_len": 1, "max_len": 6, "min_mag": 0.3, "max_mag": 0.4}, "level_shift": {"min_len": 16, "max_len": 40, "min_mag": 0.1, "max_mag": 0.3}, "flatline": {"min_len": 9, "max_len": 20}}
    plan = anomaly.injection_plan(spark, spec, 3, [1], START, 96 * 60)
    assert plan.collect() == anomaly.injection_plan(spark, spec, 3, [1], START, 96 * 60).collect()
    events = plan.withColumn("series", F.lit("s"))
    points = anomaly.spliced(load, events, ["series"]).withColumn("flag", F.col("label") != "")
    r = anomaly.detection_metrics(points, events, ["series"], "flag", 7200).first()
    assert (r["point_precision"], r["point_recall"], r["event_recall"], r["event_precision"], r["flagged_events"]) == (1, 1, 1, 1, 12)
    changed = points.join(load.withColumnRenamed("load_mw", "was"), ["series", "utc_start"]).filter("label = '' and load_mw <> was")
    assert changed.count() == 0


def test_order_statistics_without_values(spark):
    from gridtide.operators.evaluation import conformal_margin
    from gridtide.operators.order_stats import quantile

    missing = spark.createDataFrame([(1, None), (1, None), (2, 5.0)], "g int, x double")
    assert quantile(missing.filter("g = 1"), [], "x", 0.5, "m").count() == 0
    assert [tuple(r) for r in quantile(missing, ["g"], "x", 0.5, "m").collect()] == [(2, 5.0)]
    preds = missing.withColumns({"target": F.col("x"), "lo": F.col("x"), "hi": F.col("x")})
    assert conformal_margin(preds.filter("g = 1"), "lo", "hi", 0.9, []).first() is None
    assert anomaly.medians(missing, ["x"], ["g"]).orderBy("g").collect() == [(1, None), (2, 5.0)]
    assert anomaly.medians(missing, ["x"], []).first()["x"] == 5.0


def test_injected_events_keep_a_day_apart(spark):
    spec = {"spike": {"min_len": 1, "max_len": 4, "min_mag": 0.2, "max_mag": 0.5}, "drop": {"min_len": 1, "max_len": 6, "min_mag": 0.3, "max_mag": 0.4}, "level_shift": {"min_len": 16, "max_len": 40, "min_mag": 0.1, "max_mag": 0.3}, "flatline": {"min_len": 9, "max_len": 20}}
    day, least = timedelta(days=1), 96 + 12 * (96 + 40)
    seen = set()
    for n in (least, 96 * 90):
        plan = anomaly.injection_plan(spark, spec, 3, list(range(40)), START, n).toPandas()
        assert len(plan) == 40 * 12 and (plan.groupby(["seed", "kind"]).size() == 3).all()
        for _, rows in plan.groupby("seed"):
            rows = rows.sort_values("start")
            starts, ends = list(rows["start"]), list(rows["end"])
            assert starts[0] >= START + day and ends[-1] + day <= START + n * timedelta(minutes=15)
            assert all(b - a >= day for a, b in zip(ends, starts[1:]))
        for kind, rule in spec.items():
            own = plan[plan["kind"] == kind]
            assert own["intervals"].between(rule["min_len"], rule["max_len"]).all() and ((own["end"] - own["start"]) == own["intervals"] * timedelta(minutes=15)).all()
            assert own["magnitude"].abs().between(rule.get("min_mag", 0), rule.get("max_mag", 0)).all()
            seen |= {(kind, int(x > 0) - int(x < 0)) for x in own["magnitude"]}
    assert seen == {("spike", 1), ("drop", -1), ("level_shift", 1), ("level_shift", -1), ("flatline", 0)}
    with pytest.raises(Exception, match="no room for 3 events"):
        anomaly.injection_plan(spark, spec, 3, [1], START, 96 * 12).collect()
