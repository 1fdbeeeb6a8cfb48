"""Rolling-origin folds, error metrics, prediction intervals and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.functions.time import to_utc
from gridtide.functions.values import all_known
from gridtide.operators.order_stats import ranked


def _col(name: str) -> Column:
    """A column by its exact name: quantile columns have dots in theirs."""
    return F.col(f"`{name}`")


def rolling_origin_folds(first: DataFrame, n_folds: int, months: int, tz: str) -> DataFrame:
    """fold, train_end, test_start, test_end (UTC) for each row of ``first`` (keys…, first_start, limit: local times).

    Months are added in local time, the last fold ends at the limit, and none starts there or later.
    """
    keys = [c for c in first.columns if c not in ("first_start", "limit")]
    rows = first.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = (F.col("first_start") + F.make_ym_interval(F.lit(0), F.col("_i") * months)).cast("timestamp_ntz")
    end = (F.col("first_start") + F.make_ym_interval(F.lit(0), (F.col("_i") + 1) * months)).cast("timestamp_ntz")
    folds = rows.withColumn("_s", start).withColumn("_e", F.least(end, F.col("limit"))).filter("_s < limit")
    return folds.select(*keys, (F.col("_i") + 1).alias("fold"), to_utc(F.col("_s"), tz).alias("train_end"), to_utc(F.col("_s"), tz).alias("test_start"), to_utc(F.col("_e"), tz).alias("test_end"))


def fold_rows(df: DataFrame, folds: DataFrame, keys: list[str], part: str = "test", t: str = "utc_start") -> DataFrame:
    """``df`` per fold: the test rows, or the (expanding) training rows. With keys this is an equi-join on them."""
    cond = (F.col(t) >= F.col("test_start")) & (F.col(t) < F.col("test_end")) if part == "test" else F.col(t) < F.col("train_end")
    few = folds.withColumnsRenamed({k: f"_{k}" for k in keys})
    few = few if keys else F.broadcast(few)  # without keys a row per fold
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.join(few, cond).drop("train_end", "test_start", "test_end", *[f"_{k}" for k in keys])


def model_columns(columns: list[str], others: tuple[str, ...] = ("fold", "target", "utc_start", "local_date")) -> list[str]:
    """Prediction columns: all but the known others and quantiles (``_q``)."""
    return [c for c in columns if c not in others and "_q" not in c]


def long_form(preds: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    return preds.unpivot([*keep, "target"], [_col(m) for m in models], "model", "yhat")


def error_columns(y: Column, yhat: Column) -> list[Column]:
    e = F.when(all_known(y, yhat), yhat - y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.try_divide(F.abs(e), F.abs(F.when(e.isNotNull(), y))))).alias("mape_pct"), F.count(e).alias("n_hours")]


def metrics(preds: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """mae, rmse, mape_pct, n_hours per group and model, over rows where both values are known. NULL groups go."""
    rows = long_form(preds, models, by)
    for b in by:
        rows = rows.filter(F.col(b).isNotNull())
    return rows.groupBy(*by, "model").agg(*error_columns(F.col("target"), F.col("yhat")))


def cv_summary(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample standard deviation over folds per model."""
    return per_fold.groupBy(*by, "model").agg(*[f(m).alias(f"{m}_{n}") for m in ("mae", "rmse", "mape_pct") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def mae_pivot(per_fold: DataFrame, by: list[str], models: list[str], value: str = "mae") -> DataFrame:
    return per_fold.groupBy(*by).pivot("model", models).agg(F.first(value))


def sorted_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The quantile columns sorted within each row, so they never cross; any missing one leaves all missing."""
    ordered = df.withColumn("_q", F.when(all_known(*map(_col, columns)), F.array_sort(F.array(*map(_col, columns)))))
    return ordered.withColumns({c: F.col("_q")[i] for i, c in enumerate(columns)}).drop("_q")


def coverage(preds: DataFrame, pairs: dict[str, tuple[str, str, float]], by: list[str], margins: dict[str, float] | None = None) -> DataFrame:
    """Coverage and mean width per interval: name -> (low column, high column, nominal).

    A row whose target is known but a bound is not counts as not covered; widths need both bounds. With margins a
    widened variant is added.
    """
    variants = [(n, lo, hi, p, "raw", 0.0) for n, (lo, hi, p) in pairs.items()]
    variants += [(n, *pairs[n], "conformal", m) for n, m in (margins or {}).items()]
    wide = F.array(*[F.struct(F.lit(n).alias("interval"), F.lit(p).alias("nominal"), F.lit(v).alias("variant"), F.lit(float(m)).alias("margin"), _col(lo).alias("lo"), _col(hi).alias("hi")) for n, lo, hi, p, v, m in variants])
    rows = preds.select(*by, "target", F.explode(wide).alias("v")).select(*by, "target", "v.*")
    inside = F.coalesce((F.col("target") >= F.col("lo") - F.col("margin")) & (F.col("target") <= F.col("hi") + F.col("margin")), F.lit(False)).cast("double")
    return rows.groupBy(*by, "interval", "nominal", "variant", "margin").agg(F.avg(F.when(F.col("target").isNotNull(), inside)).alias("coverage"), F.avg(F.col("hi") - F.col("lo") + 2 * F.col("margin")).alias("mean_width"))


def conformal_margin(preds: DataFrame, lo: str, hi: str, nominal: float, by: list[str]) -> DataFrame:
    """Per group the order statistic of max(lo - y, y - hi) that widens the interval to ``nominal``.

    Rank min(k + 1, n) with k = ceil((n + 1) nominal), counted from 1. A group without a known score has no row.
    """
    y = F.col("target")
    scores = preds.filter(all_known(y, _col(lo), _col(hi))).select(*by, F.greatest(_col(lo) - y, y - _col(hi)).alias("score"))
    one = ranked(scores, by, "score", lambda n: [F.least(F.ceil((n + 1) * nominal) + 1, n)])
    return one.select(*by, F.get("values", F.lit(0)).alias("margin"), "n")


def typical_week(preds: DataFrame, model: str, by: list[str], local: Column, least: int) -> DataFrame:
    """The week (from Monday, local) whose mean absolute error is nearest the median over weeks of ``least`` rows."""
    weekly = preds.groupBy(*by, F.date_trunc("week", local).cast("date").alias("week")).agg(F.avg(F.abs(_col(model) - F.col("target"))).alias("mae"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("mae").isNotNull())
    middle = weekly.groupBy(*by).agg(F.median("mae").alias("median_mae"))
    near = weekly.join(middle, by) if by else weekly.crossJoin(F.broadcast(middle))  # a row per week beside one row
    return near.groupBy(*by).agg(F.min_by("week", F.struct(F.round(F.abs(F.col("mae") - F.col("median_mae")), 9), F.col("week"))).alias("week"), F.max("median_mae").alias("median_mae"))


def gain_share(importance: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    """feature, gain, share_pct, position of the ``top`` features of each group."""
    w = Window.partitionBy(*by)
    shared = importance.withColumn("share_pct", 100 * F.col("gain") / F.sum("gain").over(w))
    return shared.withColumn("position", F.row_number().over(w.orderBy(F.desc("gain"), "feature"))).filter(F.col("position") <= top)
