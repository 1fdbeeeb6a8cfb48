"""Ridge regression per group from Gram matrices that Spark sums.

Tasks turn their rows into one small matrix per group; the sums are solved exactly. Numeric columns are penalised as
if standardised (population deviation), categories as 0/1 columns; the intercept is not penalised. Unseen
categories predict as none of the known ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.values import all_known


@dataclass(frozen=True)
class Ridge:
    """categories: column -> number of codes 0..n-1."""

    numeric: tuple[str, ...]
    categories: tuple[tuple[str, int], ...]
    alpha: float = 1.0

    @property
    def width(self) -> int:
        return 1 + len(self.numeric) + sum(n for _, n in self.categories)

    def names(self) -> list[str]:
        return ["1", *self.numeric, *(f"{c}={k}" for c, n in self.categories for k in range(n))]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        parts = [np.ones((len(rows), 1)), rows[list(self.numeric)].to_numpy(float)]
        for column, n in self.categories:
            code = rows[column].to_numpy()
            parts.append((code[:, None] == np.arange(n)).astype(float))
        return np.hstack(parts)

    def solve(self, gram: np.ndarray) -> np.ndarray:
        """Coefficients from the Gram matrix of (1, columns, y)."""
        n, p = gram[0, 0], self.width
        mean = gram[0] / n
        centred = gram - n * np.outer(mean, mean)
        s, b = centred[1:p, 1:p], centred[1:p, p]
        penalty = np.full(p - 1, self.alpha)
        k = len(self.numeric)
        penalty[:k] *= np.maximum(np.diag(s)[:k] / n, 1e-12)
        beta = np.linalg.solve(s + np.diag(penalty), b)
        return np.append(mean[p] - mean[1:p] @ beta, beta)

    def _grams(self, train: DataFrame, keys: list[str], target: str) -> DataFrame:
        """keys (as strings) and the Gram matrices of (1, columns, target) of the complete rows, a few per key and task."""
        columns = [*self.numeric, *(c for c, _ in self.categories)]
        known = train.filter(all_known(*[F.col(c) for c in [*columns, target]])).select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).cast("double") for c in [*columns, target]])

        def partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for frame in frames:
                for key, rows in frame.groupby(keys, sort=False):
                    x = np.hstack([self.matrix(rows), rows[[target]].to_numpy(float)])
                    total[key] = total.get(key, 0) + x.T @ x
            yield pd.DataFrame([(*key, g.tobytes()) for key, g in total.items()], columns=[*keys, "gram"])

        return known.mapInPandas(partial, ", ".join(f"{k} string" for k in keys) + ", gram binary")

    def _solved(self, gram: np.ndarray) -> dict[str, float]:
        return dict(zip(self.names(), self.solve(gram).tolist(), strict=True))

    def fit(self, train: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
        """keys, coefficients map<string,double>; rows with any missing value are left out."""

        def solve(parts: pd.DataFrame) -> pd.DataFrame:
            gram = sum(np.frombuffer(g).reshape(self.width + 1, -1) for g in parts["gram"])
            return pd.DataFrame([(*parts[keys].iloc[0], self._solved(gram))], columns=[*keys, "coefficients"])

        schema = ", ".join(f"{k} string" for k in keys) + ", coefficients map<string,double>"
        return self._grams(train, keys, target).groupBy(*keys).applyInPandas(solve, schema)

    def fit_expanding(self, rows: DataFrame, folds: DataFrame, fold: str, target: str = "target", t: str = "utc_start") -> DataFrame:
        """fold (as string), n_rows, coefficients of each of ``folds`` (fold, train_end) with training rows before train_end.

        A row is summed once, into the block of the first fold that has it; a fold's matrix is the sum of its own and
        all earlier blocks. So no row is copied per fold.
        """
        ends = sorted((r["train_end"], r[fold]) for r in folds.select(fold, "train_end").collect())  # a row per fold
        block = F.lit(None).cast("int")
        for i, (end, _) in reversed(list(enumerate(ends))):
            block = F.when(F.col(t) < F.lit(end), F.lit(i)).otherwise(block)

        def solve(parts: pd.DataFrame) -> pd.DataFrame:
            out, gram, have = [], np.zeros((self.width + 1, self.width + 1)), parts["_block"].astype(int).to_numpy()
            for i, (_, name) in enumerate(ends):
                gram = gram + sum(np.frombuffer(g).reshape(self.width + 1, -1) for g in parts["gram"][have == i])
                if gram[0, 0]:
                    out.append((str(name), round(gram[0, 0]), self._solved(gram)))
            return pd.DataFrame(out, columns=[fold, "n_rows", "coefficients"])

        # a matrix per block and task: their sum by block first, then the running sums over as many rows as folds
        grams = self._grams(rows.withColumn("_block", block).filter("_block is not null"), ["_block"], target)

        def summed(parts: pd.DataFrame) -> pd.DataFrame:
            gram = sum(np.frombuffer(g).reshape(self.width + 1, -1) for g in parts["gram"])
            return pd.DataFrame([(parts["_block"].iloc[0], gram.tobytes())], columns=["_block", "gram"])

        blocks = grams.groupBy("_block").applyInPandas(summed, "_block string, gram binary")
        return blocks.groupBy().applyInPandas(solve, f"{fold} string, n_rows long, coefficients map<string,double>")

    def predict(self, rows: DataFrame, fitted: DataFrame, keys: list[str], name: str) -> DataFrame:
        """``rows`` with the prediction; missing where any feature is, or the group has no model."""
        models = fitted.withColumnsRenamed({k: f"_{k}" for k in keys})
        match = F.lit(True)
        for k in keys:
            match = match & (F.col(k).cast("string") == F.col(f"_{k}"))
        joined = rows.join(models, match, "left")  # a map per group: Spark broadcasts it while it is small
        c = F.col("coefficients")
        total = c["1"]
        for n in self.numeric:
            total = total + c[n] * F.col(n)
        for column, _ in self.categories:
            total = total + F.when(F.col(column).isNotNull(), F.coalesce(c[F.concat(F.lit(f"{column}="), F.col(column).cast("int").cast("string"))], F.lit(0.0)))
        return joined.withColumn(name, total).drop("coefficients", *[f"_{k}" for k in keys])
