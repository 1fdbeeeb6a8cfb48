"""Fold, metric and interval queries over daily order series with two simple forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.time import to_local
from gridtide.functions.values import day_category
from gridtide.operators import evaluation as E
from gridtide.operators.holidays import CalendarSetup, daily_calendar
from gridtide.plans.calendar_queries import DAILY, HOLIDAYS, SHARES, WEIGHTS
from gridtide.plans.inputs import PREDICTIONS_CTE, SERIES, TZ, daily_orders, predictions, rounded, table
from gridtide.sources.store import kept

QUERIES, ORACLE_SQL = {}, {}
MODELS = ["naive", "mean4"]
PAIRS = {"0.05-0.95": ("naive_q0.05", "naive_q0.95", 0.95 - 0.05), "0.1-0.9": ("naive_q0.1", "naive_q0.9", 0.9 - 0.1)}
PAIRS_SQL = "pairs(interval, nominal, lo, hi) AS (VALUES ('0.05-0.95', 0.95::DOUBLE - 0.05::DOUBLE, 0.4::DOUBLE, 1.7::DOUBLE), ('0.1-0.9', 0.9::DOUBLE - 0.1::DOUBLE, 0.6::DOUBLE, 1.4::DOUBLE))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quarters from two years after a series' first order."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    first = (F.date_trunc("quarter", "a") + F.make_ym_interval(F.lit(2))).cast("timestamp_ntz")
    return E.rolling_origin_folds(orders.select("series", first.alias("first_start"), F.col("b").cast("timestamp_ntz").alias("limit")), 8, 3, TZ)


def _utc(x: str) -> str:
    return f"timezone('UTC', timezone('{TZ}', {x}))"


FOLDS = f"""ob AS (SELECT o_orderpriority AS series, (date_trunc('quarter', min(o_orderdate)) + INTERVAL 2 YEAR)::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 1),
fl AS (SELECT series, b, i, a + INTERVAL 3 MONTH * i AS s, least(a + INTERVAL 3 MONTH * (i + 1), b) AS e FROM ob, (SELECT unnest(range(0, 8)) AS i)),
folds AS (SELECT series, (i + 1)::INT AS fold, {_utc('s')} AS train_end, {_utc('s')} AS test_start, {_utc('e')} AS test_end FROM fl WHERE s < b)"""
LONG = """lf AS (SELECT series, utc_start, target, 'naive' AS model, naive AS yhat FROM preds UNION ALL SELECT series, utc_start, target, 'mean4', mean4 FROM preds)"""
METRICS = """round(avg(abs(yhat - target)), 6) AS mae, round(sqrt(avg((yhat - target) * (yhat - target))), 6) AS rmse, round(100 * avg(abs(yhat - target) / nullif(abs(target), 0)), 6) AS mape_pct, count(yhat - target) AS n_hours"""
PER_FOLD = f"{PREDICTIONS_CTE}, {FOLDS}, {LONG}, pf AS (SELECT l.series, fold, model, {METRICS} FROM lf l JOIN folds f ON f.series = l.series AND utc_start >= test_start AND utc_start < test_end GROUP BY 1, 2, 3)"


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold_rows(predictions(spark, sf_dir), folds(spark, sf_dir), SERIES)


def per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(fold_predictions(spark, sf_dir), MODELS, ["series", "fold"])


@query(f"WITH {FOLDS} SELECT * FROM folds")
def rolling_origin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(spark, sf_dir)


@query(f"WITH {PER_FOLD} SELECT * FROM pf")
def metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(per_fold(spark, sf_dir))


@query(f"""WITH {PER_FOLD} SELECT series, model, {', '.join(f"round({f}({m}), 4) AS {m}_{n}" for m in ('mae', 'rmse', 'mape_pct') for n, f in (('mean', 'avg'), ('std', 'stddev_samp')))} FROM pf GROUP BY 1, 2""")
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.cv_summary(rounded(per_fold(spark, sf_dir)), SERIES), 4)


@query(f"WITH {PREDICTIONS_CTE}, {LONG} SELECT series, model, {METRICS} FROM lf WHERE utc_start >= TIMESTAMP '2000-01-01' GROUP BY 1, 2")
def metrics_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metrics(predictions(spark, sf_dir).filter("utc_start >= timestamp_ntz'2000-01-01 00:00:00'"), MODELS, SERIES))


@query(f"WITH {PER_FOLD} SELECT series, fold, max(mae) FILTER (model = 'naive') AS naive, max(mae) FILTER (model = 'mean4') AS mean4 FROM pf GROUP BY 1, 2")
def mae_fold_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mae_pivot(rounded(per_fold(spark, sf_dir)), ["series", "fold"], MODELS)


def _local(x: str = "utc_start") -> str:
    return f"timezone('{TZ}', timezone('UTC', {x}))"


@query(f"WITH {PREDICTIONS_CTE}, {LONG} SELECT series, hour({_local()})::INT AS hour, model, {METRICS} FROM lf GROUP BY 1, 2, 3")
def breakdown_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = predictions(spark, sf_dir).withColumn("hour", F.hour(to_local(F.col("utc_start"), TZ)))
    return rounded(E.metrics(preds, MODELS, ["series", "hour"]))


@query(f"WITH {PREDICTIONS_CTE}, {LONG} SELECT series, (isodow({_local()}) - 1)::INT AS weekday, model, {METRICS} FROM lf GROUP BY 1, 2, 3")
def breakdown_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = predictions(spark, sf_dir).withColumn("weekday", F.weekday(to_local(F.col("utc_start"), TZ)))
    return rounded(E.metrics(preds, MODELS, ["series", "weekday"]))


@query(f"""WITH {PREDICTIONS_CTE}, {LONG}, years AS (SELECT DISTINCT unnest([year(o_orderdate) - 1, year(o_orderdate), year(o_orderdate) + 1])::INT AS y FROM orders), {HOLIDAYS}, {SHARES}, {DAILY}
SELECT series, CASE WHEN is_holiday = 1 THEN 'holiday' WHEN bridge_day = 1 THEN 'bridge day' WHEN isodow(local_date) >= 6 THEN 'weekend' ELSE 'normal workday' END AS day_category, model, {METRICS}
FROM lf JOIN daily ON local_date = {_local()}::DATE GROUP BY 1, 2, 3""")
def breakdown_day_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = predictions(spark, sf_dir).withColumn("local_date", F.to_date(to_local(F.col("utc_start"), TZ)))
    days = daily_calendar(spark, preds.select("local_date"), CalendarSetup(WEIGHTS))
    kind = day_category(F.col("is_holiday"), F.col("bridge_day"), (F.weekday("local_date") >= 5).cast("int"))
    return rounded(E.metrics(preds.join(days, "local_date").withColumn("day_category", kind), MODELS, ["series", "day_category"]))


@query(f"""WITH {PREDICTIONS_CTE}, s AS (SELECT series, utc_start, list_sort([naive * 1.7, mean4 * 0.4, naive, mean4]) AS q, naive IS NOT NULL AND mean4 IS NOT NULL AS ok FROM preds)
SELECT series, utc_start, CASE WHEN ok THEN round(q[1], 6) END AS a, CASE WHEN ok THEN round(q[2], 6) END AS b, CASE WHEN ok THEN round(q[3], 6) END AS c, CASE WHEN ok THEN round(q[4], 6) END AS d FROM s""")
def sorted_quantile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = predictions(spark, sf_dir).select("series", "utc_start", (F.col("naive") * 1.7).alias("a"), (F.col("mean4") * 0.4).alias("b"), F.col("naive").alias("c"), F.col("mean4").alias("d"))
    return rounded(E.sorted_quantiles(crossed, ["a", "b", "c", "d"]))


COVER = """v AS (SELECT p.*, interval, nominal, naive * lo AS l, naive * hi AS h, variant, margin FROM preds p, pairs, (VALUES ('raw', 0.0::DOUBLE), ('conformal', 5000.0::DOUBLE)) m(variant, margin))"""


@query(f"""WITH {PREDICTIONS_CTE}, {PAIRS_SQL}, {COVER} SELECT series, interval, nominal, variant, margin,
round(avg(coalesce(target BETWEEN l - margin AND h + margin, false)::INT) FILTER (target IS NOT NULL), 6) AS coverage, round(avg(h - l + 2 * margin), 6) AS mean_width FROM v GROUP BY 1, 2, 3, 4, 5""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.coverage(predictions(spark, sf_dir), PAIRS, SERIES, dict.fromkeys(PAIRS, 5000.0)), 6).withColumn("nominal", F.col("nominal"))


@query(f"""WITH {PREDICTIONS_CTE}, {PAIRS_SQL}, {COVER} SELECT series, (isodow({_local()}) - 1)::INT AS weekday, interval, nominal, variant, margin,
round(avg(coalesce(target BETWEEN l - margin AND h + margin, false)::INT) FILTER (target IS NOT NULL), 6) AS coverage, round(avg(h - l + 2 * margin), 6) AS mean_width FROM v GROUP BY 1, 2, 3, 4, 5, 6""")
def coverage_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = predictions(spark, sf_dir).withColumn("weekday", F.weekday(to_local(F.col("utc_start"), TZ)))
    return rounded(E.coverage(preds, PAIRS, ["series", "weekday"], dict.fromkeys(PAIRS, 5000.0)), 6)


@query(f"""WITH {PREDICTIONS_CTE}, s AS (SELECT series, greatest(naive * 0.4 - target, target - naive * 1.7) AS score FROM preds WHERE naive IS NOT NULL AND target IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score) AS k, count(*) OVER (PARTITION BY series) AS n FROM s)
SELECT series, round(score, 6) AS margin, n FROM r WHERE k = least(ceil((n + 1) * 0.9) + 1, n)""")
def conformal_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.conformal_margin(kept(predictions(spark, sf_dir), "predictions"), "naive_q0.05", "naive_q0.95", 0.9, SERIES))


@query(f"""WITH {PREDICTIONS_CTE}, w AS (SELECT series, date_trunc('week', {_local()})::DATE AS week, avg(abs(naive - target)) AS mae, count(*) AS n FROM preds GROUP BY 1, 2 HAVING count(*) >= 7),
m AS (SELECT series, median(mae) AS median_mae FROM w GROUP BY 1)
SELECT series, arg_min(week, (round(abs(mae - median_mae), 9), week)) AS week, round(any_value(median_mae), 6) AS median_mae FROM w JOIN m USING (series) WHERE mae IS NOT NULL GROUP BY series""")
def typical_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.typical_week(predictions(spark, sf_dir), "naive", SERIES, to_local(F.col("utc_start"), TZ), 7))


@query("""WITH g AS (SELECT o_orderpriority AS series, year(o_orderdate) || '-' || month(o_orderdate) AS feature, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS gain FROM orders GROUP BY 1, 2),
s AS (SELECT *, 100 * gain / sum(gain) OVER (PARTITION BY series) AS share_pct, row_number() OVER (PARTITION BY series ORDER BY gain DESC, feature) AS position FROM g)
SELECT series, feature, gain, round(share_pct, 6) AS share_pct, position::INT AS position FROM s WHERE position <= 15""")
def importance_share_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"))
    gain = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("feature")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("gain"))
    return rounded(E.gain_share(gain, SERIES))


@query(f"""WITH {PREDICTIONS_CTE}, {FOLDS} SELECT f.fold, p.series, p.utc_start, p.target, p.naive FROM preds p JOIN folds f ON f.series = p.series AND utc_start >= test_start AND utc_start < test_end
UNION ALL SELECT NULL, series, utc_start, target, naive FROM preds WHERE utc_start >= TIMESTAMP '2000-01-01'""")
def union_oof_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["series", "utc_start", "target", "naive"]
    test = predictions(spark, sf_dir).filter("utc_start >= timestamp_ntz'2000-01-01 00:00:00'").select(*columns)
    return rounded(fold_predictions(spark, sf_dir).select("fold", *columns).unionByName(test, allowMissingColumns=True))


def day_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Daily rows with a few known-ahead features, split into train and test at 2000."""
    load = daily_orders(spark, sf_dir)
    from gridtide.operators.timegrid import lags

    back = lags(load, SERIES, "load_mw", {f"lag{d}d": 24 * d for d in (7, 14, 28)})
    rows = load.join(back, [*SERIES, "utc_start"], "left").withColumnRenamed("load_mw", "target")
    rows = rows.withColumns({"weekday": F.weekday("utc_start"), "month": F.month("utc_start") - 1, "trend": F.datediff(F.to_date("utc_start"), F.lit("1995-01-01")) / 1000.0})
    part = F.when(F.col("utc_start") < F.lit("2000-01-01").cast("timestamp_ntz"), "train").otherwise("test")
    return rows.withColumn("part", part), ["lag7d", "lag14d", "lag28d", "weekday", "month", "trend"]


@query(None)
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.models.ridge import Ridge

    rows, _ = day_parts(spark, sf_dir)
    model = Ridge(("lag7d", "lag14d", "lag28d", "trend"), (("weekday", 7), ("month", 12)))
    fitted = model.fit(rows.filter("part = 'train'"), SERIES)
    return rounded(model.predict(rows.filter("part = 'test'"), fitted, SERIES, "ridge").select("series", "utc_start", "target", "ridge"), 3)


SMALL = {"trees": 60, "rate": 0.08, "leaves": 15, "least": 20}


@query(None)
def gbdt_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.models.gbdt import Params, fit_predict

    rows, features = day_parts(spark, sf_dir)
    return rounded(fit_predict(rows, SERIES, features, Params(**SMALL)), 3)


@query(None)
def gbdt_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.models.gbdt import Params, fit_predict

    rows, features = day_parts(spark, sf_dir)
    levels = {"gbdt_q05": 0.05, "gbdt_q10": 0.1, "gbdt_q90": 0.9, "gbdt_q95": 0.95}
    return rounded(E.sorted_quantiles(fit_predict(rows, SERIES, features, Params(**{**SMALL, "trees": 30}), levels), list(levels)), 3)


@query(None)
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtide.models import gbdt

    rows, features = day_parts(spark, sf_dir)
    return rounded(gbdt.gain_importance(rows.filter("part = 'train'"), SERIES, features, gbdt.Params(**SMALL)), 3)


@query("""WITH o AS (SELECT o_orderpriority AS series, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS total, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT *, unnest([0.05, 0.1, 0.5, 0.9, 1.0])::DOUBLE AS q FROM o)
SELECT series, format('{:g}', q) AS level, format('{:.2f}', total) AS total_plain, format('{:,.2f}', total) AS total_grouped, format('{:,d}', n) AS orders_grouped,
       'load_q' || format('{:g}', q) AS column_name, 'Total price of orders' AS heading, regexp_replace('mae_mw_mean', '_mean$', '') AS metric, 'https://example.org/' || series || '/' || n || '.csv' AS url FROM l""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number, name and template texts of reports, over the orders of each priority."""
    from gridtide.functions import text

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"))
    facts = orders.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total"), F.count("*").alias("n"))
    rows = facts.withColumn("q", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.5, 0.9, 1.0)))))
    level = text.short_number(F.col("q"))
    return rows.select(
        "series",
        level.alias("level"),
        text.fixed(F.col("total"), 2).alias("total_plain"),
        text.grouped(F.col("total"), 2).alias("total_grouped"),
        text.grouped(F.col("n")).alias("orders_grouped"),
        F.concat(F.lit("load_q"), level).alias("column_name"),
        text.heading(F.lit("total_price_of_ORDERS")).alias("heading"),
        text.without_suffix(F.lit("mae_mw_mean"), "_mean").alias("metric"),
        text.from_template("https://example.org/{series}/{n}.csv", series=F.col("series"), n=F.col("n")).alias("url"),
    )


@query(f"""WITH {PREDICTIONS_CTE}, ob AS (SELECT (date_trunc('quarter', min(o_orderdate)) + INTERVAL 2 YEAR)::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders),
fl AS (SELECT b, i, a + INTERVAL 3 MONTH * i AS s FROM ob, (SELECT unnest(range(0, 8)) AS i)),
f AS (SELECT (i + 1)::INT AS fold, {_utc('s')} AS train_end FROM fl WHERE s < b)
SELECT fold, count(*) AS n_rows, round(regr_intercept(target, naive), 1) AS intercept, round(regr_slope(target, naive), 6) AS slope
FROM f JOIN preds ON utc_start < train_end WHERE target IS NOT NULL AND naive IS NOT NULL GROUP BY 1""")
def expanding_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through all series' values a week apart, fitted before each of eight quarters from one pass over the rows."""
    from gridtide.models.ridge import Ridge

    rows = kept(predictions(spark, sf_dir).select("utc_start", "target", "naive"), "predictions")
    orders = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    first = (F.date_trunc("quarter", "a") + F.make_ym_interval(F.lit(2))).cast("timestamp_ntz")
    quarters = E.rolling_origin_folds(orders.filter("a is not null").select(first.alias("first_start"), F.col("b").cast("timestamp_ntz").alias("limit")), 8, 3, TZ)
    fitted = Ridge(("naive",), (), 0.0).fit_expanding(rows, quarters, "fold")
    lines = fitted.select(F.col("fold").cast("int").alias("fold"), F.col("n_rows"), F.round(F.col("coefficients")["1"], 1).alias("intercept"), F.round(F.col("coefficients")["naive"], 6).alias("slope"))
    return lines


@query(None)
def gbdt_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per series and quarter of boosters fitted before each quarter: all folds in the same jobs, no row copied."""
    from gridtide.models import gbdt

    rows, features = day_parts(spark, sf_dir)
    rows, quarters = kept(rows.drop("part"), "days"), kept(folds(spark, sf_dir), "folds")
    each = quarters.groupBy("series").pivot("fold", list(range(1, 9))).agg(F.first("train_end"))
    ends = each.select(F.col("series").alias("_series"), *[F.col(str(k)).alias(f"_end{k}") for k in range(1, 9)])
    known = rows.join(ends, F.col("series") == F.col("_series")).drop("_series")
    known = known.select(*rows.columns, *[(F.col("utc_start") < F.col(f"_end{k}")).alias(f"_fold{k}") for k in range(1, 9)])
    params = gbdt.Params(**{**SMALL, "trees": 20})
    nodes = gbdt.fit(known, SERIES, [gbdt.Fit(f"gbdt@{k}", tuple(features), params, f"_fold{k}") for k in range(1, 9)])
    named = nodes.select("series", F.split("model", "@")[1].cast("int").alias("fold"), F.lit("gbdt").alias("model"), *[c for c in nodes.columns if c not in ("series", "model")])
    test = E.fold_rows(rows, quarters, SERIES)
    made = gbdt.predict(test, ["series", "fold", "utc_start", "target"], named, ["series", "fold"], ["gbdt"])
    return rounded(E.metrics(made, ["gbdt"], ["series", "fold"]))
