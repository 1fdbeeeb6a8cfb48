"""The four stages over files: data, train, evaluate, anomalies. Each is a function of a session and a configuration.

Between stages everything is Parquet below the configured paths; reports are CSV, JSON and Markdown.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import to_utc
from gridtide.functions.values import day_category
from gridtide.models import gbdt, iforest
from gridtide.models.ridge import Ridge
from gridtide.operators import anomaly as A
from gridtide.operators import cleaning, evaluation, features, weather
from gridtide.operators.timegrid import spine, spread_to_steps
from gridtide.sources import fetch, sinks, workbook
from gridtide.sources.config import Config

#: The numeric inputs of the linear models.
LINEAR = ("holiday_share", "bridge_day", "day_before_holiday", "day_after_holiday", "school_holiday_proxy", "doy_sin", "doy_cos")
CODES = (("hour_daytype", 72), ("month", 13))
BOOSTED = ("gbdt_no_weather", "gbdt_lagged_weather", "gbdt_oracle_weather")
MODELS = ["seasonal_naive", "linear_calendar", "linear_lags_weather", *BOOSTED]
ORACLE = "gbdt_oracle_weather"


def _at(config: Config, text: str) -> datetime:
    return datetime.fromisoformat(str(text))


def _utc(spark: SparkSession, config: Config, text: str) -> datetime:
    """A local time of the configuration as an instant."""
    one = spark.createDataFrame([(_at(config, text),)], "t timestamp_ntz").select(to_utc(F.col("t"), config["timezone"]))
    return one.first()[0]


def _ends(spark: SparkSession, config: Config, step: int) -> DataFrame:
    start, end = _utc(spark, config, config["split"]["start"]), _utc(spark, config, config["split"]["end"])
    ends = spark.createDataFrame([(start, end)], "first timestamp_ntz, end timestamp_ntz")
    return ends.select("first", F.timestamp_add("SECOND", F.lit(-step), F.col("end")).alias("last"))


def run_data(spark: SparkSession, config: Config, download: bool = True, force: bool = False) -> None:
    """Raw workbooks and weather files to clean quarter-hour, hourly and weather tables and a validation report."""
    if download:
        fetch.write_manifest(config, fetch.fetch_workbooks(config, force) + fetch.fetch_weather(config, force))
    load = config["load"]
    head, data = workbook.sheet_parts(workbook.read_sheets(spark, config.path("raw"), load["sheet"]))
    cleaning.checked_header(head, load["header_prefix"], load["unit"]).count()
    rows = cleaning.parsed(data)
    low, high = map(float, load["range_mw"])
    setup = cleaning.CleaningSetup(config["timezone"], low, high, int(load["interpolate"]), load["long_gaps"])
    cleaning.clean_load(rows, [], _ends(spark, config, 900), setup).write.mode("overwrite").parquet(config.path("interim", "load15"))
    quarter = spark.read.parquet(config.path("interim", "load15"))
    cleaning.to_hourly(quarter, []).write.mode("overwrite").parquet(config.path("processed", "hourly"))
    w = config["weather"]
    schema = "time string, " + ", ".join(f"{v} double" for v in w["variables"])
    raw = spark.read.schema(schema).csv(config.path("raw", "weather-*.csv"), header=True)
    named = raw.withColumn("location", F.regexp_extract(F.input_file_name(), r"weather-([^/]+)\.csv$", 1)).withColumn("utc_start", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm"))).drop("time")
    weights = weather.location_weights(config.locations(spark), config.population(spark))
    weather.national(weather.to_interval_start(named, ["location"]), weights).write.mode("overwrite").parquet(config.path("processed", "weather"))
    hourly, record = (spark.read.parquet(config.path("processed", n)) for n in ("hourly", "weather"))
    counts = cleaning.validation_record(quarter, hourly, record, cleaning.load_instants(data, config["timezone"]).select("utc_start"))
    files = cleaning.file_report(data, config["timezone"])
    years = files.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.lit(load["header_prefix"]).alias("header"), F.lit(load["unit"]).alias("unit"), *["file", "rows", "first_label", "last_label", "convention", "non_numeric", "repeated_local_labels", F.to_json("dst_days").alias("dst_days")]))).alias("years"))
    sinks.write_json(years.crossJoin(counts), config.path("reports", "validation.json"))  # one row each
    sinks.write_text(config.path("reports", "validation.md"), "# Data validation\n\n" + sinks.markdown_table(files.drop("dst_days"), order=["file"]) + "\n" + sinks.markdown_table(counts))


def feature_table(spark: SparkSession, config: Config, hourly: DataFrame, keys: list[str]) -> DataFrame:
    setup = config.forecast_setup()
    index = spine(_ends(spark, config, 3600), 3600)
    if keys:
        index = index.crossJoin(F.broadcast(hourly.select(*keys).distinct()))  # a row per seed
    return features.feature_frame(spark, index, hourly, spark.read.parquet(config.path("processed", "weather")), keys, setup, config.calendar_setup())


def boosters(config: Config) -> tuple[dict[str, list[str]], dict[str, gbdt.Params], dict[str, dict[str, float]]]:
    """Feature lists and parameters of all boosters, and the quantile columns of each model."""
    m, sets = config["models"], features.feature_sets(config.forecast_setup())
    point = gbdt.Params(int(m["trees"]), float(m["rate"]), int(m["leaves"]), int(m["least"]), seed=int(config["seed"]))
    columns, params, quantiles = {}, {}, {}
    for name in BOOSTED:
        columns[name], params[name] = sets[name.removeprefix("gbdt_")], point
        quantiles[name] = {f"{name}_q{q:g}": float(q) for q in m["quantiles"]} if name != "gbdt_no_weather" else {}
        for column, q in quantiles[name].items():
            columns[column] = columns[name]
            params[column] = gbdt.Params(int(m["quantile_trees"]), float(m["rate"]), int(m["quantile_leaves"]), int(m["quantile_least"]), quantile=q, seed=int(config["seed"]))
    return columns, params, quantiles


def fold_table(spark: SparkSession, config: Config) -> DataFrame:
    """Every fold and, as fold 0, the final test period: fold, train_end, test_start, test_end."""
    s = config["split"]
    first = spark.createDataFrame([(_at(config, s["first_fold"]), _at(config, s["test_start"]))], "first_start timestamp_ntz, limit timestamp_ntz")
    folds = evaluation.rolling_origin_folds(first, int(s["folds"]), int(s["fold_months"]), config["timezone"])
    start, end = _utc(spark, config, s["test_start"]), _utc(spark, config, s["end"])
    final = spark.createDataFrame([(0, start, start, end)], "fold int, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")
    return folds.unionByName(final)


def fitted_boosters(frame: DataFrame, folds: DataFrame, config: Config) -> DataFrame:
    """fold, model and nodes of all boosters of all folds, fitted together: a fold is a boolean column, not a copy."""
    columns, params, _ = boosters(config)
    ends = {r["fold"]: r["train_end"] for r in folds.collect()}  # a row per fold
    known = frame.withColumns({f"_fold{k}": F.col("utc_start") < F.lit(end) for k, end in ends.items()})
    fits = [gbdt.Fit(f"{m}@{k}", tuple(columns[m]), params[m], f"_fold{k}") for m in params for k in ends]
    nodes = gbdt.fit(known, [], fits)
    named = F.split("model", "@")
    return nodes.select(named[1].cast("int").alias("fold"), named[0].alias("model"), *[c for c in nodes.columns if c != "model"])


def predicted(frame: DataFrame, folds: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """fold, utc_start, target and all models' predictions and quantiles of the test rows of each fold."""
    _, _, quantiles = boosters(config)
    lagged = [c for c in features.feature_sets(config.forecast_setup())["lagged_weather"] if c not in features.CALENDAR]
    out, made = evaluation.fold_rows(frame, folds, [], "test"), ["fold", "utc_start", "target", "seasonal_naive"]
    out = out.withColumn("seasonal_naive", F.col("load_lag168h"))
    for name, numeric in (("linear_calendar", LINEAR), ("linear_lags_weather", [*LINEAR, *lagged])):
        ridge = Ridge(tuple(numeric), CODES, float(config["models"]["ridge_alpha"]))
        out = ridge.predict(out, ridge.fit_expanding(frame, folds, "fold").drop("n_rows"), ["fold"], name)
        made.append(name)
    for name in BOOSTED:
        out = gbdt.predict(out, out.columns, nodes, ["fold"], [name, *quantiles[name]])
        if quantiles[name]:
            out = evaluation.sorted_quantiles(out, list(quantiles[name]))
        made += [name, *quantiles[name]]
    return out.select(*[f"`{c}`" for c in made])


def run_train(spark: SparkSession, config: Config) -> None:
    """Features, the boosters of all folds and the final ones (fold 0), predictions, and the final models' gains."""
    hourly = spark.read.parquet(config.path("processed", "hourly"))
    feature_table(spark, config, hourly, []).write.mode("overwrite").parquet(config.path("processed", "features"))
    frame, folds = spark.read.parquet(config.path("processed", "features")), fold_table(spark, config)
    fitted_boosters(frame, folds, config).write.mode("overwrite").parquet(config.path("models", "boosters"))
    nodes = spark.read.parquet(config.path("models", "boosters"))
    predicted(frame, folds, nodes, config).write.mode("overwrite").parquet(config.path("processed", "predictions"))
    columns, _, _ = boosters(config)
    final = nodes.filter("fold = 0").drop("fold")
    gains = gbdt.importance(final.filter(F.col("model").isin(*BOOSTED)), [], {n: columns[n] for n in BOOSTED})
    sinks.write_csv(gains.groupBy("feature").pivot("model", list(BOOSTED)).agg(F.first("gain")), config.path("reports", "importance.csv"), ["feature"])


def predictions(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold and test predictions."""
    both = spark.read.parquet(config.path("processed", "predictions"))
    return both.filter("fold > 0"), both.filter("fold = 0").drop("fold")


def run_evaluate(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Metrics per fold, their summary, test metrics, breakdowns and interval coverage, written as CSV and Markdown."""
    oof, test = predictions(spark, config)
    frame = spark.read.parquet(config.path("processed", "features"))
    category = day_category(F.col("is_holiday"), F.col("bridge_day"), F.col("is_weekend"))
    attributes = frame.select("utc_start", "hour", "weekday", category.alias("day_category"))
    models = evaluation.model_columns(oof.columns)
    per_fold = evaluation.metrics(oof, models, ["fold"])
    out = {"metrics_per_fold": per_fold, "cv_summary": evaluation.cv_summary(per_fold, []), "metrics_test": evaluation.metrics(test, models, [])}
    for by in ("hour", "weekday", "day_category"):
        out[f"test_error_by_{by}"] = evaluation.metrics(test.join(attributes, "utc_start", "left"), models, [by])
    tables = []
    for name in BOOSTED[1:]:
        pairs = {f"{lo:g}-{hi:g}": (f"{name}_q{lo:g}", f"{name}_q{hi:g}", hi - lo) for lo, hi in config["models"]["intervals"]}
        margins = {n: evaluation.conformal_margin(oof, lo, hi, p, []).first() for n, (lo, hi, p) in pairs.items()}
        known = {n: row["margin"] for n, row in margins.items() if row and row["margin"] is not None}
        tables.append(evaluation.coverage(oof, pairs, []).select(F.lit(name).alias("model"), F.lit("cv").alias("period"), "*"))
        tables.append(evaluation.coverage(test, pairs, [], known).select(F.lit(name).alias("model"), F.lit("test").alias("period"), "*"))
    cover = tables[0]
    for t in tables[1:]:
        cover = cover.unionByName(t)
    out["interval_coverage"] = cover
    importance = sinks.read_csv(spark, config.path("reports", "importance.csv"))
    long = importance.select("feature", F.explode(F.create_map(*[x for c in importance.columns[1:] for x in (F.lit(c), F.col(f"`{c}`").cast("double"))])).alias("model", "gain"))
    out["gain_share"] = evaluation.gain_share(long.filter("gain is not null"), ["model"])
    text = "# Forecast results\n"
    for name, df in out.items():
        order = [c for c in df.columns if c in ("fold", "model", "hour", "weekday", "day_category", "period", "interval", "variant", "position")]
        sinks.write_csv(df, config.path("reports", f"{name}.csv"), order)
        text += f"\n## {name}\n\n{sinks.markdown_table(df, 3, order)}"
    sinks.write_text(config.path("reports", "results.md"), text)
    return out


def _limit(threshold: DataFrame) -> float:
    """A threshold of one group; without any known score nothing lies above it."""
    row = threshold.first()
    return float("inf") if row is None else row["threshold"]


def run_anomalies(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Real residual, isolation-forest and flatline events, and the study with injected events, all seeds in one job."""
    a, tz = config["anomaly"], config["timezone"]
    oof, test = predictions(spark, config)
    lo, hi = (f"`{ORACLE}_q{q:g}`" for q in a["interval"])
    width, gap = float(a["least_width"]), int(a["gap_hours"]) * 3600
    score = A.residual_score(F.col("target"), F.col(lo), F.col(hi), width)
    limit = _limit(A.threshold(oof.withColumn("score", score), "score", float(a["residual_rate"]), []))
    frame = spark.read.parquet(config.path("processed", "features"))
    holidays = frame.groupBy("local_date").agg(F.first("holiday_name", ignorenulls=True).alias("holiday_name"))
    real = oof.drop("fold").unionByName(test).select("utc_start", F.col("target").alias("actual"), F.col(ORACLE).alias("expected"), score.alias("score"))
    residual = A.event_summary(real.withColumn("flag", F.coalesce(F.col("score") > limit, F.lit(False))), [], "flag", gap, 3600, tz, "expected", holidays=holidays)

    quarter = spark.read.parquet(config.path("interim", "load15")).select("utc_start", "load_mw")
    cut = _utc(spark, config, config["split"]["test_start"])
    A.detector_features(quarter, [], tz).write.mode("overwrite").parquet(config.path("interim", "detector"))
    points = spark.read.parquet(config.path("interim", "detector"))
    train = points.filter(F.col("utc_start") < F.lit(cut))
    forest = iforest.fit(train, A.FEATURES, ["utc_start"], int(a["trees"]), int(a["sample"]), seed=int(config["seed"]))
    iforest.with_score(points, forest).select("utc_start", F.col("load_mw").alias("actual"), "score").write.mode("overwrite").parquet(config.path("interim", "scores"))
    scored = spark.read.parquet(config.path("interim", "scores"))
    forest_limit = _limit(A.threshold(scored.filter(F.col("utc_start") < F.lit(cut)), "score", float(a["forest_rate"]), []))
    isolated = A.event_summary(scored.withColumn("flag", F.col("score") > forest_limit), [], "flag", gap, 900, tz, holidays=holidays)
    flat = cleaning.flatlines(quarter, [], "load_mw", int(a["min_run"])).filter("flatline_flag")

    injection_study(spark, config, quarter, cut, limit, forest, forest_limit).write.mode("overwrite").parquet(config.path("interim", "study"))
    study = spark.read.parquet(config.path("interim", "study"))
    summary = A.detection_summary(study, ["method"], [c for c in study.columns if c not in ("seed", "method")])
    out = {"anomalies_residual": residual, "anomalies_isolation_forest": isolated, "anomalies_flatline": flat, "injection_per_seed": study, "injection_summary": summary}
    text = f"# Anomalies\n\nResidual threshold {limit:.4f}, isolation-forest threshold {forest_limit:.4f}.\n"
    for name, order in (("anomalies_residual", [F.desc("abs_deviation")]), ("anomalies_isolation_forest", [F.desc("max_score")])):
        text += f"\n## {name}\n\n{sinks.markdown_table(out[name].orderBy(*order).limit(int(a['top'])), 3)}"
    means = summary.select("method", *[F.col(c).alias(c.removesuffix("_mean")) for c in summary.columns if c.endswith("_mean")])
    text += f"\n## Injected events, means over seeds\n\n{sinks.markdown_table(means, 2, ['method'])}"
    for name, df in out.items():
        sinks.write_csv(df, config.path("reports", f"{name}.csv"))
    sinks.write_text(config.path("reports", "anomalies.md"), text)
    return out


def injection_study(spark: SparkSession, config: Config, quarter: DataFrame, cut: datetime, limit: float, forest: iforest.Forest, forest_limit: float) -> DataFrame:
    """seed, method and detection metrics of five ways to combine the detectors; the seed is a key like any other."""
    a, tz = config["anomaly"], config["timezone"]
    tested = quarter.filter(F.col("utc_start") >= F.lit(cut))
    n = tested.count()
    events = A.injection_plan(spark, a["injection"], int(a["per_kind"]), list(a["seeds"]), cut, n)
    seeds = F.explode(F.array(*[F.lit(int(s)) for s in a["seeds"]])).alias("seed")
    whole = A.spliced(quarter.select("*", seeds), events, ["seed"])
    hourly = cleaning.to_hourly(whole, ["seed"])
    columns, _, quantiles = boosters(config)
    names = [f"{ORACLE}_q{q:g}" for q in a["interval"]]
    final = spark.read.parquet(config.path("models", "boosters")).filter("fold = 0").drop("fold")
    rows = feature_table(spark, config, hourly, ["seed"]).filter(F.col("utc_start") >= F.lit(cut))
    bounds = evaluation.sorted_quantiles(gbdt.predict(rows, ["seed", "utc_start", "target"], final, [], list(quantiles[ORACLE])), list(quantiles[ORACLE]))
    flags = bounds.withColumn("residual", F.coalesce(A.residual_score(F.col("target"), F.col(f"`{names[0]}`"), F.col(f"`{names[1]}`"), float(a["least_width"])) > limit, F.lit(False)))
    points = whole.filter(F.col("utc_start") >= F.lit(cut)).select("seed", "utc_start", "label", "load_mw")
    points = spread_to_steps(flags.select("seed", "utc_start", "residual"), ["seed"], "residual", 3600, points)
    isolated = iforest.with_score(A.detector_features(whole, ["seed"], tz), forest).select("seed", "utc_start", (F.col("score") > forest_limit).alias("isolation_forest"))
    flat = cleaning.flatlines(points.select("seed", "utc_start", "load_mw"), ["seed"], "load_mw", int(a["min_run"])).select("seed", "utc_start", F.col("flatline_flag").alias("flatline_rule"))
    joined = points.join(isolated, ["seed", "utc_start"], "left").join(flat, ["seed", "utc_start"], "left")
    r, i, f = (F.coalesce(c, F.lit(False)) for c in ("residual", "isolation_forest", "flatline_rule"))
    methods = {"residual": r, "isolation_forest": i, "flatline_rule": f, "residual_or_isolation_forest": r | i, "all_three_combined": r | i | f}
    each = joined.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), c.alias("flag")) for k, c in methods.items()]))).select("seed", "m.method", "utc_start", "label", "m.flag")
    named = events.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    return A.detection_metrics(each, named, ["seed", "method"], "flag", int(a["gap_hours"]) * 3600)
