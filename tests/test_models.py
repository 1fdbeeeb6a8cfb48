from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.models import gbdt, iforest
from gridtide.models.ridge import Ridge


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(5, 3, (300, 2)), rng.integers(0, 4, 300)
    y = x @ [2.0, -1.0] + c * 3.0 + rng.normal(0, 0.1, 300)
    rows = [("g", float(a), float(b), int(k), float(t)) for (a, b), k, t in zip(x, c, y)]
    frame = spark.createDataFrame([*rows, ("g", None, 1.0, 1, 2.0)], "key string, a double, b double, c int, target double").repartition(3)
    model = Ridge(("a", "b"), (("c", 5),))
    got = model.predict(frame.filter("a is not null"), model.fit(frame, ["key"]), ["key"], "p").orderBy("a").toPandas()
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.eye(5)[c]])
    zc = z - z.mean(0)
    beta = np.linalg.solve(zc.T @ zc + np.eye(7), zc.T @ (y - y.mean()))
    want = (y.mean() + zc @ beta)[np.argsort(x[:, 0])]
    assert np.allclose(got["p"], want)
    unseen = model.predict(frame.limit(1).withColumn("c", F.lit(9)), model.fit(frame, ["key"]), ["key"], "p")
    assert unseen.first()["p"] is not None


def boosted(spark, x, y, fits, parts=2):
    """Predictions of each fit for all rows, fitted where _train, in the order of the rows."""
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", target double").repartition(parts)
    frame = frame.withColumn("_train", F.col("id") % 3 != 0)
    nodes = gbdt.fit(frame, [], fits)
    return gbdt.predict(frame, ["id"], nodes, [], [f.model for f in fits]).orderBy("id").toPandas(), nodes


def test_boosting_beats_the_mean_and_routes_missing_values(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (2000, 3))
    y = np.where(np.isnan(x[:, 1]), 0, np.sin(2 * x[:, 0]) + (x[:, 1] > 0)) + rng.normal(0, 0.05, 2000)
    x[::5, 2] = np.nan
    y[::5] += 2
    out, nodes = boosted(spark, x, y, [gbdt.Fit("m", ("x0", "x1", "x2"), gbdt.Params(80, 0.1, 15, 10), "_train")])
    held = np.arange(2000) % 3 == 0
    error = np.abs(out["m"] - y)[held].mean()
    assert error < 0.25 * np.abs(y[held] - y[~held].mean()).mean()
    gains = {r["feature"]: r["gain"] for r in gbdt.importance(nodes, [], {"m": ["x0", "x1", "x2", "none"]}).collect()}
    assert gains.pop("none") == 0 and len(gains) == 3 and min(gains.values()) > 0


def test_quantiles_cover_their_share(spark, monkeypatch):
    monkeypatch.setattr(gbdt, "NEAR", 600)
    monkeypatch.setattr(gbdt, "FEW", 64)  # leaves of many values are narrowed step by step
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, 1))
    y = x[:, 0] + rng.normal(0, 0.2, 3000)
    levels = (0.05, 0.5, 0.9, 0.95)
    out, _ = boosted(spark, x, y, [gbdt.Fit(f"q{q}", ("x0",), gbdt.Params(30, 0.2, 8, 50, quantile=q), "_train") for q in levels])
    held = np.arange(3000) % 3 == 0
    for q in levels:
        assert abs((y <= out[f"q{q}"])[held].mean() - q) < 0.035
        assert abs((y <= out[f"q{q}"])[~held].mean() - q) < 0.02


def one_machine(x, y, trees, rate, leaves, least, l2, q=None):
    """The method written down for one machine: all rows, all columns, level by level, then the largest gains."""
    cuts = [np.unique(c[~np.isnan(c)])[:-1] for c in x.T]
    bins = np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c)) for c, e in zip(x.T, cuts, strict=True)])
    now = np.full(len(y), np.mean(y) if q is None else np.quantile(y, q))
    gains = np.zeros(x.shape[1])

    def split(rows, g):
        best = None
        for missing_left in (True, False):
            for j in range(len(bins)):
                for cut in range(1, len(cuts[j]) + 2):
                    left = (bins[j, rows] <= cut) & (missing_left | (bins[j, rows] > 0))
                    a, b = g[left], g[~left]
                    if min(len(a), len(b)) >= least:
                        gain = a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - g.sum() ** 2 / (len(g) + l2)
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, j, rows[left], rows[~left])
        return best

    for _ in range(trees):
        error = y - now
        g = error if q is None else np.where(error > 0, q, q - 1)
        done, heap = [], [(np.arange(len(y)), 0, split(np.arange(len(y)), g))]
        while heap and len(done) + len(heap) < leaves:
            heap.sort(key=lambda e: -(e[2][0] if e[2] and e[1] < int(np.ceil(np.log2(leaves))) else -1))
            rows, depth, found = heap.pop(0)
            if not found or depth >= int(np.ceil(np.log2(leaves))):
                heap.insert(0, (rows, depth, None))
                break
            gains[found[1]] += found[0]
            heap += [(part, depth + 1, split(part, g[part]) if len(part) >= 2 * least else None) for part in found[2:]]
        for rows, _, _ in heap:
            now[rows] += rate * (error[rows].sum() / (len(rows) + l2) if q is None else np.quantile(error[rows], q))
    return now, gains


@pytest.mark.parametrize("near", [0, 60, 65_536])
def test_boosting_over_partitions_equals_one_machine(spark, monkeypatch, near):
    monkeypatch.setattr(gbdt, "NEAR", near)  # sums by bins only, both, or whole trees in tasks
    monkeypatch.setattr(gbdt, "CHUNK", 50)
    monkeypatch.setattr(gbdt, "STORE", 3)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    x[rng.random(400) < 0.2, 1] = np.nan
    y = 3.0 * x[:, 0] + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(0, 0.5, 400)
    names, flat = ("x0", "x1", "x2"), {"row_share": 1.0, "column_share": 1.0}
    fits = [gbdt.Fit("mean", names, gbdt.Params(7, 0.3, 6, 5, **flat)), gbdt.Fit("high", names, gbdt.Params(5, 0.5, 4, 20, quantile=0.8, **flat))]
    out, nodes = boosted(spark, x, y, fits, 5)
    gains = gbdt.importance(nodes, [], {f.model: list(names) for f in fits}).toPandas().set_index(["model", "feature"])["gain"]
    for name, want in (("mean", one_machine(x, y, 7, 0.3, 6, 5, 1.0)), ("high", one_machine(x, y, 5, 0.5, 4, 20, 1.0, 0.8))):
        assert np.allclose(out[name], want[0], atol=1e-5)
        assert np.allclose([gains[name, c] for c in names], want[1], rtol=1e-4, atol=1e-4)


def test_boosting_edges(spark, monkeypatch):
    monkeypatch.setattr(gbdt, "FITS", 2)  # a block of two keys at a time
    rows = [(k, float(i % 7), None if i % 3 else float(i), float(i % 7)) for k in ("a", "b", None, "c", "d") for i in range(40)] + [("e", 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "key string, x double, z double, target double")
    nodes = gbdt.fit(frame, ["key"], [gbdt.Fit("m", ("x", "z"), gbdt.Params(20, 0.5, 8, 2, 1.0, 1.0, 0.0))])
    out = gbdt.predict(frame, ["key", "target"], nodes, ["key"], ["m"])
    assert out.filter("target is not null and abs(m - target) > 0.01").count() == 0
    assert out.filter("key = 'e' and m is null").count() == 1 and out.count() == len(rows)
    none = gbdt.fit(frame.limit(0), ["key"], [gbdt.Fit("m", ("x",), gbdt.Params(3))])
    assert gbdt.fit(frame.limit(0), [], [gbdt.Fit("m", ("x",), gbdt.Params(3))]).count() == 0
    assert none.count() == 0 and gbdt.predict(frame, ["target"], none, ["key"], ["m"]).filter("m is not null").count() == 0


def test_expanding_folds_equal_separate_fits(spark):
    rng = np.random.default_rng(4)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=i), float(a), int(i % 3), float(2 * a + i % 3 + rng.normal(0, 0.1))) for i, a in enumerate(rng.normal(0, 1, 300))]
    frame = spark.createDataFrame(rows, "utc_start timestamp_ntz, a double, c int, target double").repartition(4)
    ends = {3: start + timedelta(hours=100), 1: start + timedelta(hours=200), 2: start + timedelta(hours=260), 9: start - timedelta(hours=1)}
    folds = spark.createDataFrame(list(ends.items()), "fold int, train_end timestamp_ntz")
    model = Ridge(("a",), (("c", 3),))
    got = {r["fold"]: r["coefficients"] for r in model.fit_expanding(frame, folds, "fold").collect()}
    assert set(got) == {"1", "2", "3"}
    for fold in (1, 2, 3):
        alone = model.fit(frame.filter(F.col("utc_start") < F.lit(ends[fold])).withColumn("k", F.lit("x")), ["k"]).first()["coefficients"]
        assert {k: round(v, 8) for k, v in got[str(fold)].items()} == {k: round(v, 8) for k, v in alone.items()}


def test_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (2000, 2)))] + [(9000, 9.0, -9.0), (9001, None, None)]
    frame = spark.createDataFrame(rows, "id int, a double, b double")
    forest = iforest.fit(frame, ["a", "b"], ["id"], trees=60, sample=256)
    top = iforest.with_score(frame, forest).orderBy(F.desc("score")).first()
    assert top["id"] == 9000 and top["score"] > 0.7
    assert iforest.expected_path(2) == 1.0 and abs(float(iforest.expected_path(256)) - 10.24) < 0.02


def test_isolation_trees_part_all_rows():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 300):
        x = np.round(rng.normal(0, 1, (n, 3)), 1)
        x[:, 2] = 5.0  # never split
        feature, cut, left, path = iforest.grow(x, np.random.default_rng(n))
        at, depth = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            at[inner] = left[at[inner]] + (x[inner, feature[at[inner]]] >= cut[at[inner]])
            depth[inner] += 1
        sizes = np.bincount(at, minlength=len(feature))
        assert set(np.flatnonzero(sizes)) == set(np.flatnonzero(feature < 0)) and 2 not in feature
        assert np.allclose(path[at], depth + iforest.expected_path(sizes[at])) and depth.max() <= np.ceil(np.log2(max(n, 2)))
        for leaf in np.unique(at):  # a leaf of several rows is at full depth or of equal rows
            same = x[at == leaf]
            assert len(same) == 1 or (same == same[0]).all() or depth[at == leaf][0] == np.ceil(np.log2(n))


def test_fit_predict_per_series(spark):
    start = datetime(2024, 1, 1)
    rows = [(s, "train" if i < 300 else "test", start + timedelta(hours=i), float(i % 24 + k), float(i % 24)) for k, s in enumerate("ab") for i in range(400)]
    frame = spark.createDataFrame(rows, "series string, part string, utc_start timestamp_ntz, target double, hour double")
    out = gbdt.fit_predict(frame, ["series"], ["hour"], gbdt.Params(60, 0.2, 31, 3), {"lo": 0.1})
    assert out.count() == 200 and out.filter("abs(gbdt - target) > 0.6").count() == 0
