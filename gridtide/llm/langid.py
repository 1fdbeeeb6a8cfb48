"""Language identification by averaged hashed subword embeddings and a linear softmax.

Training (numpy, stochastic gradient descent) sees a bounded sample of labelled documents; each comes to the driver
as hashed subword counts, so its size is bounded by ``BUCKETS`` whatever the text's length. Prediction runs in the
tasks over whole texts. Averaging and the output layer are both linear, so the embedding table and the softmax
weights fold into one table of a row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
SIZES = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: ASCII other than letters becomes a space; n-grams run over words with their borders.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def subword_buckets(text: str) -> np.ndarray:
    """Bucket of every byte n-gram of the lower-cased text, white space and punctuation collapsed."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(TO_SPACE).split()) + b" "
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out, key = [], a
    for n in range(2, max(SIZES) + 1):
        if len(a) < n:
            break
        key = key[:-1] * np.uint32(1000003) + a[n - 1 :]
        if n in SIZES:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(2654435761)
            out.append((mixed >> np.uint32(8)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        buckets = subword_buckets(text)
        counts = np.bincount(buckets, minlength=BUCKETS).astype(np.float32)
        return counts @ self.table / np.float32(max(len(buckets), 1)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, epochs: int = 5, rate: float = 60.0, seed: int = 7, precision: float = 0.99) -> Model:
    """rows: (bucket ids, counts) of each document, in order of langs' labels. A fifth is held back to calibrate."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weight = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for i, k in enumerate(ids):
            buckets, counts = rows[k]
            x[i, buckets] = counts / max(counts.sum(), 1)
        return x

    batch = 32
    steps, done = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), batch):
            ids = fit[at : at + batch]
            x = dense(ids)
            hidden = x @ embed
            p = softmax(hidden @ weight + bias)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            now = rate * (1 - done / steps)
            grad = x.T @ (p @ weight.T)
            weight -= 0.05 * now * (hidden.T @ p)
            bias -= 0.05 * now * p.sum(axis=0)
            embed -= now * grad
            done += 1
    model = Model(names, (embed @ weight).astype(np.float32), bias)
    if len(held):
        logits = dense(held) @ model.table + bias
        losses = {t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        for t in np.sort(top):  # the lowest threshold whose accepted predictions are precise enough
            if right[top >= t].mean() >= precision:
                model.threshold = float(t)
                break
        else:
            model.threshold = 1.0
    return model


def fit_language_model(labelled: DataFrame, sample: int = 3000) -> Model:
    """Learn from (doc_id, text, lang). ``sample``: the most documents that training sees, the first by a hash of doc_id.

    Rows with NULL text, NULL lang, NULL id or no letter teach nothing and are left out. Of rows that repeat an id the
    first by text and lang is taken.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lang, packed = [], [], []
            for doc_id, text, name in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if LETTER.search(text):
                    buckets, counts = np.unique(subword_buckets(text), return_counts=True)
                    ids.append(doc_id)
                    lang.append(name)
                    packed.append(np.concatenate([buckets, counts]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(packed, pa.binary())], names=["doc_id", "lang", "counts"])

    keys = labelled.filter("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    chosen = keys.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = F.min(F.struct("text", "lang")).alias("x")
    few = keys.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "x.*")  # at most `sample` ids
    got = sorted((r["doc_id"], r["lang"], bytes(r["counts"])) for r in few.mapInArrow(count, "doc_id long, lang string, counts binary").collect())
    rows = [np.frombuffer(c, "<u4").astype(np.int64).reshape(2, -1) for _, _, c in got]
    return train([(r[0], r[1]) for r in rows], [lang for _, lang, _ in got])


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted of every row of ``docs`` (doc_id, text).

    ``und`` with score 0 where text is NULL or has no letter, or nothing was learned. ``accepted`` is the calibrated
    rejection: the score reaches the threshold that held the wanted precision on the calibration part. Texts of any
    length are read whole, repeated rows judged each; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
