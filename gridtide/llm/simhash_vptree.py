"""SimHash near-duplicates through vantage-point trees.

1. Tasks turn every whole text into a fingerprint; equal fingerprints collapse before anything is compared, so a group
   of exact copies is one item.
2. A top tree of vantage points, from a bounded sample, cuts the items into shards by Hamming distance. An item lives
   in the shard of its leaf and visits the outer leaves that the triangle bound leaves open within the radius.
3. In a shard a vantage-point tree is searched with blocks of queries; links join a union-find at once, so a shard
   gives at most one link per item (a spanning forest), never all pairs of a group.
4. Connected components run over these links in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import connected_components
from gridtide.llm.shared import stored

SEED = 42
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(words: list[bytes], n: int) -> list[bytes]:
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included; words as op3 defines them (A-Z lower-cased)."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text.lower().split(), n)], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none. Bits are counted by byte histograms."""
    if not len(h):
        return 0
    by_byte = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ BIT_OF_BYTE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


@dataclass
class Node:
    """A vantage point and the median distance: inside is at most ``cut`` away. Leaves are shard numbers."""

    point: int
    cut: int
    inside: "Node | int"
    outside: "Node | int"


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator, first: int = 0) -> tuple[Node | int, int]:
    """A tree of at most ``depth`` levels over the sample; the node (or leaf number) and the next free number."""
    if depth == 0 or len(sample) < 4:
        return first, first + 1
    best = None
    for p in sample[rng.integers(0, len(sample), 8)]:  # the vantage point that spreads the distances most
        d = np.bitwise_count(sample ^ p).astype(np.int64)
        if best is None or d.std() > best[0]:
            best = (d.std(), p, d)
    _, point, d = best
    cut = int(np.median(d))
    if (d <= cut).all():
        cut -= 1
    if not (d <= cut).any():
        return first, first + 1
    inside, first = grow(sample[d <= cut], depth - 1, rng, first)
    outside, first = grow(sample[d > cut], depth - 1, rng, first)
    return Node(int(point), cut, inside, outside), first


def route(node: Node | int, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf, whether it lives there) of the leaves where an item must be met.

    An item at home inside visits the outside branch where its ball of ``radius`` may reach it, not the reverse: of a
    pair that a node parts the inner one visits the outer one's leaf. Visitors take every branch in reach.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: Node | int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, node, home))
            return
        d = np.bitwise_count(items[at] ^ np.uint64(node.point)).astype(np.int64)
        lives = d <= node.cut
        near, far = lives | (~home & (d - radius <= node.cut)), d + radius > node.cut
        walk(node.inside, at[near], (home & lives)[near])
        walk(node.outside, at[far], (home & ~lives)[far])

    walk(node, np.arange(len(items)), np.ones(len(items), dtype=bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), k) for a, k, _ in out]), np.concatenate([h for _, _, h in out])


class Forest:
    """Union-find over positions, smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def close_pairs(points: np.ndarray, radius: int, home: np.ndarray | None = None, leaf: int = 192, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of position pairs within ``radius``, each pair once, from a vantage-point tree over the points at ``home``.

    Points that are guests (not at home) meet only those at home; two guests meet in a shard where one is at home.
    """
    home = np.ones(len(points), bool) if home is None else home
    rng = np.random.default_rng(3)

    def among(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, others = max(1, cells // max(len(p), 1)), points[p]  # as many distances at a time as memory should hold
        for at in range(0, len(q), block):
            mine = q[at : at + block]
            i, j = np.nonzero(np.bitwise_count(points[mine, None] ^ others) <= radius)
            i, j = mine[i], p[j]
            keep = (i < j) | ~home[i]
            if keep.any():
                yield i[keep], j[keep]

    def search(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """q: queries, p: the points of the subtree."""
        if not len(q) or not len(p):
            return
        if len(p) <= leaf:
            yield from among(q, p)
            return
        best = None
        for c in points[p[rng.integers(0, len(p), 4)]]:
            d = np.bitwise_count(points[p] ^ c).astype(np.int64)
            cut = int(np.median(d))
            part = (d <= cut).mean()
            spread = min(part, 1 - part) * (1 + d.std())
            if best is None or spread > best[0]:
                best = (spread, c, d, cut)
        spread, c, d, cut = best
        if spread == 0:
            cut = int(d.max()) - 1
            if not (d <= cut).any():
                yield from among(q, p)
                return
        dq = np.bitwise_count(points[q] ^ c).astype(np.int64)
        near, far = dq - radius <= cut, dq + radius > cut
        if near.mean() + far.mean() > 1.97:  # the bound prunes nothing here
            yield from among(q, p)
            return
        yield from search(q[near], p[d <= cut])
        yield from search(q[far], p[d > cut])

    yield from search(np.arange(len(points)), np.flatnonzero(home))


def shard_links(ids: np.ndarray, points: np.ndarray, radius: int, home: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a shard that span all its pairs within ``radius``."""
    forest, out = Forest(len(ids)), []
    for i, j in close_pairs(points, radius, home):
        names = np.unique(np.concatenate([i, j]))  # keep of each block only what can join anything new
        root = np.array([forest.find(x) for x in names])
        ri, rj = root[np.searchsorted(names, i)], root[np.searchsorted(names, j)]
        _, first = np.unique(np.minimum(ri, rj) * len(ids) + np.maximum(ri, rj), return_index=True)
        first = first[ri[first] != rj[first]]
        for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
            if forest.join(a, b):
                out.append((int(ids[a]), int(ids[b])))
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fingerprint (signed 64 bits) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(hashes(text.as_py() or b"", words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(items: DataFrame, n: int, fps: DataFrame, radius: int, shard_items: int, sample: int = 20_000) -> DataFrame:
    """Links (a, b) that span the ``n`` items (id, fp) within ``radius`` bits; fps: their fingerprints, for the top tree's sample."""
    depth = max(0, int(np.ceil(np.log2(max(n / shard_items, 1)))))
    some = [r["fp"] for r in fps.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()] if depth else []
    tree, _ = grow(np.array(some, dtype=np.int64).view(np.uint64), depth, np.random.default_rng(1))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, leaf, home = route(tree, batch.column(1).to_numpy().view(np.uint64), radius)
            rows = [pa.array(leaf), *(batch.column(k).take(pa.array(at)) for k in range(2)), pa.array(home)]
            yield pa.RecordBatch.from_arrays(rows, names=["shard", "id", "fp", "home"])

    def join(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("id")
        points, home = shard.column("fp").to_numpy().view(np.uint64), shard.column("home").to_numpy()
        found = shard_links(shard.column("id").to_numpy(), points, radius, home)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return items.mapInArrow(place, "shard long, id long, fp long, home boolean").groupBy("shard").applyInArrow(join, "a long, b long")


def fingerprint_components(docs: DataFrame, words: int = 3, radius: int = 2, shard_items: int = 16_384) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    Documents link where their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest doc_id
    reachable. NULL and blank texts have fingerprint zero and link like any other. Rows with a NULL doc_id keep their
    row and take part through their fingerprint; the component of a group without any id is NULL.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # The fingerprint itself names the item: components are found among fingerprints, then take the smallest doc_id.
    found = connected_components(links(classes.select(F.col("fp").alias("id"), "fp"), classes.count(), classes, radius, shard_items), "links")
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
