"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its surface (character classes,
hashed byte pairs, word variety), a hidden layer and gated attention (tanh times sigmoid) weigh the passages, and
the weighted representation gives the document's score; only documents carry labels. The network is trained here
in numpy on a bounded sample of labelled documents and scores whole texts inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 64
PAIRS = 32
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", ".", ",", "!?", "|", "#*$%&<>", "\"'()[]{}", "=/@_-+:;~^`\\")
CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _chars in enumerate(CLASSES):
    CLASS_OF[list(_chars.encode())] = _i
CLASS_OF[0x80:0xC0] = len(CLASSES) + 1  # rest bytes of longer characters
N_CLASSES = len(CLASSES) + 2
WIDTH = N_CLASSES + PAIRS + 4


def encode(text: bytes) -> np.ndarray:
    """A row of WIDTH numbers per passage; an empty text is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, WIDTH), dtype=np.float32)
    parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    joined = [b" ".join(p) + b" " for p in parts]
    a = np.frombuffer(b"".join(joined), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(j) for j in joined])
    passage = np.repeat(np.arange(len(parts)), lengths)
    classes = np.bincount(CLASS_OF[a] + N_CLASSES * passage, minlength=N_CLASSES * len(parts)).reshape(-1, N_CLASSES)
    pairs = np.bincount((a[:-1] * 31 + a[1:] * 17) % PAIRS + PAIRS * passage[:-1], minlength=PAIRS * len(parts)).reshape(-1, PAIRS)
    size = np.maximum(lengths, 1)[:, None]
    seen: set[bytes] = set()
    more = np.empty((len(parts), 4))
    for i, p in enumerate(parts):
        before = len(seen)
        seen.update(p)
        more[i] = len(set(p)) / len(p), (len(seen) - before) / len(p), lengths[i] / len(p) / 16, np.log1p(len(p)) / 4
    return np.concatenate([classes / size, pairs / size, more], axis=1).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """x: passages of all bags; starts: the first passage of each bag."""
        w, n = self.weights, len(x)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        h = np.tanh(x @ w["w1"] + w["b1"])
        t = np.tanh(h @ w["v"])
        g = 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        attention = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(attention[:, None] * h, starts)
        logit = z @ w["c"] + w["c0"][0]
        return logit, {"x": x, "bag": bag, "h": h, "t": t, "g": g, "attention": attention, "z": z}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        logit, _ = self.forward(np.concatenate(bags), starts)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the logistic loss. With fewer than two classes the score is the share of label 1 (a half if none)."""
    if len(set(labels.tolist())) < 2:
        return Network(np.zeros(WIDTH), np.ones(WIDTH), prior=float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    net = Network(rows.mean(axis=0), rows.std(axis=0) + 1e-3)
    shape = {"w1": (WIDTH, hidden), "b1": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden,), "c0": (1,)}
    net.weights = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b1", "c0") else np.zeros(s)) for k, s in shape.items()}
    w = net.weights
    m, v, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    total = epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            part = [bags[i] for i in ids]
            starts = np.cumsum([0, *(len(b) for b in part[:-1])])
            logit, s = net.forward(np.concatenate(part), starts)
            d = (1 / (1 + np.exp(-logit)) - labels[ids]) / len(ids)
            dz = d[:, None] * w["c"]
            dh = s["attention"][:, None] * dz[s["bag"]]
            da = (s["h"] * dz[s["bag"]]).sum(axis=1)
            mean = np.add.reduceat(s["attention"] * da, starts)[s["bag"]]
            de = s["attention"] * (da - mean)
            gated = s["t"] * s["g"]
            dgated = de[:, None] * w["a"]
            dt, dg = dgated * s["g"] * (1 - s["t"] ** 2), dgated * s["t"] * s["g"] * (1 - s["g"])
            dh += dt @ w["v"].T + dg @ w["u"].T
            dx = dh * (1 - s["h"] ** 2)
            grads = {"w1": s["x"].T @ dx, "b1": dx.sum(axis=0), "v": s["h"].T @ dt, "u": s["h"].T @ dg, "a": gated.T @ de, "c": s["z"].T @ d, "c0": np.array([d.sum()])}
            step += 1
            now = rate * min(1.0, 1.2 * (1 - step / total) + 0.05)
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = 4000, passages: int = 512) -> Network:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text).

    ``sample``: the most labelled documents that training sees, the first by a hash of doc_id; ``passages``: the most
    passages of one, spread evenly over it (scoring reads all). Rows with NULL doc_id or quality teach nothing; NULL
    text counts as empty. Where labels repeat an id, the larger label holds; where documents do, the first text.
    """

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column(2):
                bag = encode(text.as_py() or b"")
                packed.append(bag[np.linspace(0, len(bag) - 1, min(len(bag), passages)).astype(np.int64)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "quality", "bag"])

    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    few = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["quality"], bytes(r["bag"])) for r in few.select("doc_id", "quality", "text").mapInArrow(bags, "doc_id long, quality int, bag binary").collect())
    return train([np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(np.float64) for _, _, b in got], np.array([q for _, q, _ in got], dtype=np.float64))


def with_score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the score of every row's whole text as column ``name`` (replaced where it exists already).

    NULL and blank texts are one passage of zeros and get a score like any other; repeated rows are scored each; an
    empty table gives no rows. Other columns pass through.
    """
    rest = docs.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])
    columns = rest.columns
    at = columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            bags: list[np.ndarray] = []
            size = 0
            for text in batch.column(at):
                bags.append(encode((text.as_py() or "").encode("utf-8", "replace")))
                size += len(bags[-1])
                if size > 20_000:
                    scores += net.score(bags).tolist()
                    bags, size = [], 0
            if bags:
                scores += net.score(bags).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, name])

    return rest.mapInArrow(run, schema)
