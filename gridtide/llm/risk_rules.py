"""Quality rules whose cutoffs come with a guarantee.

Every document gets a few surface measures. A *level* from 1 (lenient) to ``LEVELS`` (strict) sets all cutoffs at
once, along a path fixed in advance; a document's own level is the first at which some rule rejects it. For each
stratum the labelled good documents then test level after level, from lenient to strict, the hypothesis "this level
rejects more than ``alpha`` of the good documents": the exact binomial tail must fall to ``delta`` divided by the
number of strata (Bonferroni), and the walk stops at the first level that fails (fixed-sequence testing, so the
levels need no further correction). With probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents to the chosen cutoffs. A stratum without enough labels keeps level 0, which rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shared import stored

LEVELS = 128
#: measure: (most lenient cutoff, strictest cutoff); a document fails a rule above its cutoff.
#: The strict ends lie where most documents fail, so the bound and not the path's end chooses the level.
PATHS = {"symbol_share": (1.0, 0.0004), "upper_share": (1.0, 0.0625), "mean_word_chars": (400.0, 0.49), "dup_line_share": (1.0, 0.0625), "repeat_share": (1.0, 0.01), "same_word_share": (1.0, 0.0625)}
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
SPACE = b" \t\n\x0b\x0c\r"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_positions(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; exact: windows are ranked by doubling, not hashed."""
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = rank[: len(rank) - step], rank[step:]
        values, rank, counts = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True, return_counts=True)
        if len(values) == len(rank):
            return 0
        width += step
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[rank] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[list[int], dict[str, float]]:
    """The counts of COLUMNS, and the measures of PATHS."""
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid.translate(None, CONTINUATION))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    dups = len(lines) - len(set(lines))
    symbols = len(text.translate(None, NOT_SYMBOLS))
    repeats = repeated_positions(words)
    n = len(words)
    top = 0
    if n:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        top = max(counts.values())
    some = max(n, 1)
    return [n, chars, symbols, dups, repeats], {"symbol_share": symbols / max(chars, 1), "upper_share": len(solid.translate(None, NOT_UPPER)) / max(chars, 1), "mean_word_chars": chars / some, "dup_line_share": dups / max(len(lines), 1), "repeat_share": repeats / some, "same_word_share": top / some if n >= MIN_WORDS else 0.0}


def cutoffs(level: int) -> dict[str, float]:
    """All rules' cutoffs at a level: geometric steps from the lenient to the strict end."""
    return {name: lenient * (strict / lenient) ** (level / LEVELS) for name, (lenient, strict) in PATHS.items()}


def own_level(values: dict[str, float], grid: dict[str, np.ndarray]) -> int:
    """First level that rejects; LEVELS + 1 if none does."""
    first = LEVELS + 1
    for name, value in values.items():
        above = value > grid[name]  # cutoffs fall with the level, so this turns true once
        if above[-1]:
            first = min(first, int(np.argmax(above)) + 1)
    return first


def measured(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, the counts and the document's own level; NULL text has no words, NULL stratum is its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [cutoffs(k) for k in range(1, LEVELS + 1)]
        grid = {name: np.array([row[name] for row in table]) for name in PATHS}
        for batch in batches:
            rows = [measure(t.as_py() or b"") for t in batch.column(2)]
            counts = np.array([c for c, _ in rows], dtype=np.int64).reshape(-1, len(COLUMNS))
            levels = [own_level(v, grid) for _, v in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(counts[:, i]) for i in range(len(COLUMNS))), pa.array(levels, pa.int64())], names=["doc_id", "stratum", *COLUMNS, "level"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", level long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), as a regularised incomplete beta function (any n)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p

    def beta(a: float, b: float, x: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d, out = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300), 1.0
        out = d
        for m in range(1, 10_000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + step * d) or 1e-300)
                c = (1 + step / c) or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-13:
                break
        return front * out

    return beta(a, b, x) if x < (a + 1) / (a + b + 2) else 1 - beta(b, a, 1 - x)


def choose_levels(histogram: dict[str, dict[int, int]], alpha: float, delta: float) -> dict[str, int]:
    """The strictest level that each stratum's good documents prove safe. histogram: stratum to level to count."""
    chosen = {}
    for stratum, counts in histogram.items():
        n, rejected, best = sum(counts.values()), 0, 0
        for level in range(1, LEVELS + 1):
            rejected += counts.get(level, 0)
            if binomial_tail(rejected, n, alpha) > delta / len(histogram):
                break
            best = level
        chosen[stratum] = best
    return chosen


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, level, cutoff_level.

    ``labels`` (doc_id, quality): rows with quality 1 are the good documents; those that fail the base rules are
    left out of the holdout, because the cutoffs decide only about documents that pass them. A labelled id counts
    once, by its worst row. No labels: level 0 everywhere, so only the base rules reject. Repeated rows are judged each by itself.
    """
    spark = docs.sparkSession
    rows = stored(measured(docs, stratum).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))), "rules")
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    each = rows.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi").groupBy("stratum", "doc_id").agg(F.min("level").alias("level"))
    counted = each.groupBy("stratum", "level").count()
    histogram: dict[str, dict[int, int]] = {}
    for row in counted.collect():  # strata times levels at most
        histogram.setdefault(row["stratum"], {})[row["level"]] = row["count"]
    chosen = choose_levels(histogram, alpha, delta)
    cut = spark.createDataFrame(list(chosen.items()), "stratum string, cutoff_level long")
    out = rows.join(cut, "stratum", "left").withColumn("cutoff_level", F.coalesce("cutoff_level", F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("level") > F.col("cutoff_level"))
    return out.select("doc_id", *COLUMNS, "base_failed", kept.alias("kept"), "stratum", "level", "cutoff_level")
