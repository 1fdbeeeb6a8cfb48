"""Isolation forest (Liu, Ting and Zhou 2008).

Trees see samples of ``sample`` rows of the whole table, as the method has it, and grow in tasks; every row is scored,
in the tasks, by the forest as a broadcast of a size that its parameters bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators.anomaly import medians as medians_of

def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    columns: list[str]
    medians: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature, cut, left child, path length of leaves
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for outliers."""
        if not self.trees:
            return np.zeros(len(x))
        x = np.where(np.isnan(x), self.medians, x)
        total = np.zeros(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                node = at[inner]
                at[inner] = left[node] + (x[inner, feature[node]] >= cut[node])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(expected_path(self.sample)), 1e-9))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays, a level at a time; children of a node are neighbours."""
    limit, depth = int(np.ceil(np.log2(max(len(x), 2)))), 0
    feature, cut, left, path = [np.full(1, -1)], [np.zeros(1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
    rows, starts, made = np.arange(len(x)), np.zeros(1, dtype=np.int64), 1
    while True:  # ``rows`` lie node by node of this level
        sizes = np.diff(np.append(starts, len(rows)))
        low, high = np.minimum.reduceat(x[rows], starts, axis=0), np.maximum.reduceat(x[rows], starts, axis=0)
        spread = high > low
        split = spread.any(axis=1) & (sizes > 1) & (depth < limit)
        path[-1][~split] = depth + expected_path(sizes[~split])
        if not split.any():
            return tuple(np.concatenate(c) for c in (feature, cut, left, path))
        pick = np.floor(rng.random(len(sizes)) * spread.sum(axis=1))
        f = np.argmax(np.cumsum(spread, axis=1) > pick[:, None], axis=1)
        lo, hi = low[np.arange(len(f)), f], high[np.arange(len(f)), f]
        at = hi - rng.random(len(sizes)) * (hi - lo)
        at = np.where(at > lo, at, hi)  # both sides get a row
        order, n = np.cumsum(split) - 1, int(split.sum())
        feature[-1][split], cut[-1][split], left[-1][split] = f[split], at[split], made + 2 * order[split]
        node = np.repeat(np.arange(len(sizes)), sizes)
        rows, node = rows[split[node]], node[split[node]]
        child = 2 * order[node] + (x[rows, f[node]] >= at[node])
        turn = np.argsort(child, kind="stable")
        rows, starts = rows[turn], np.searchsorted(child[turn], np.arange(2 * n))
        feature.append(np.full(2 * n, -1))
        cut.append(np.zeros(2 * n))
        left.append(np.zeros(2 * n, dtype=np.int64))
        path.append(np.zeros(2 * n))
        made, depth = made + 2 * n, depth + 1


def fit(train: DataFrame, columns: list[str], order: list[str], trees: int = 300, sample: int = 2048, seed: int = 42) -> Forest:
    """A forest whose trees each see a sample of their own of the whole table, about ``sample`` rows chosen by hashes.

    Rows are sent to the trees that drew them and each tree grows in a task; what returns is the trees, of a size that
    the parameters bound. Missing values become the medians of all rows.
    """
    columns = list(columns)
    values = train.select(*order, *[F.col(c).cast("double").alias(c) for c in columns])
    middle = medians_of(values, columns, []).first()
    medians = np.array([0.0 if middle is None or middle[c] is None else middle[c] for c in columns], dtype=float)
    rows = values.count()
    size = min(sample, rows)
    if not size:
        return Forest(columns, medians, [], 0)
    # A row is drawn by rounds of trees: in each it goes to one tree, if at all, so a round costs a row once.
    rounds = -(-trees * size // rows)
    share = trees * size / (rounds * rows)
    drawn = values.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    chance = F.pmod(F.xxhash64(*order, "_round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    tree = F.pmod(F.xxhash64(F.lit(seed + 1), *order, "_round"), F.lit(trees)).cast("int")
    drawn = drawn.filter(chance < share).select(tree.alias("tree"), *columns)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[columns].to_numpy(float)
        x = np.where(np.isnan(x), medians, x)
        x = x[np.lexsort(x.T)]  # the order of arrival is not part of the result
        feature, cut, left, path = grow(x, np.random.default_rng([seed, int(rows["tree"].iloc[0])]))
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "feature": [feature.tolist()], "cut": [cut.tolist()], "left": [left.tolist()], "path": [path.tolist()]})

    grown = drawn.groupBy("tree").applyInPandas(one, "tree int, feature array<long>, cut array<double>, left array<long>, path array<double>")
    made = [(np.array(r["feature"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["path"])) for r in sorted(grown.collect(), key=lambda r: r["tree"])]
    return Forest(columns, medians, made, size)


def with_score(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``df`` with the anomaly score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    schema = df.drop(name).schema.simpleString()[7:-1]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            frame[name] = model.score(frame[model.columns].to_numpy(float))
            yield frame

    return df.drop(name).mapInPandas(run, f"{schema},{name}:double")
