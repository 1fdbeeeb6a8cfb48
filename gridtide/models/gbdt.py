"""Gradient-boosted trees from gradient histograms that Spark sums.

Rows are binned once and packed into chunks (one stored row of a few thousand observations, a byte a value). A tree
grows level by level: each task turns its chunks into gradient sums by (fit, node, feature, bin), Spark adds them up,
and the best cut of each node comes back, a row per node; a node of at most ``NEAR`` rows is finished by one task, which
makes the same cuts. Many fits (series, folds, feature sets, quantiles) share the chunks and the jobs, so a fold copies
no row and a level is one job whatever the number of fits. A fit whose training rows are at most ``NEAR`` is such a node
in every tree: one task grows all its trees from one shuffle, and all such fits are one job. No task holds more than
``NEAR`` rows of a fit. Gradients are whole numbers of a fixed unit: sums are exact in any order, so a fit does not
depend on the number of partitions, on lost tasks, or on which of the two ways it took.

Squared loss takes leaf values from the sums. A quantile fit's leaf is the exact order statistic of what is left in it,
found by narrowing intervals of counts until one holds few values. A model is a table with a row per node.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.sources.store import kept, new_path, remove

BINS = 64
#: Observations of a chunk; bytes of sums that a task holds before it hands them on.
CHUNK, HELD = 8192, 64 << 20
#: Rows that are counted for all features at once.
AT_ONCE = 1500
#: A node of so many rows goes to one task, to be split to the end; a fit of so many, to be boosted to the end.
NEAR = 65_536
#: Fits that share their jobs, and trees after which the scores of the rows are stored.
FITS, STORE = 1024, 16
#: A leaf's values are narrowed until so many are left, in so many intervals a step.
FEW, STEPS = 65_536, 1024
#: Bits of a gradient's unit: sums of 2**28 rows stay exact, with three bits of room above the largest target.
UNIT_BITS = 30


@dataclass(frozen=True)
class Params:
    trees: int = 600
    rate: float = 0.03
    leaves: int = 63
    least: int = 30
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    quantile: float | None = None
    seed: int = 42

    @property
    def depth(self) -> int:
        return max(1, int(np.ceil(np.log2(max(self.leaves, 2)))))


@dataclass(frozen=True)
class Fit:
    """A booster per key. ``part`` is a boolean column of its training rows (NULL: not one of them); without, all are."""

    model: str
    features: tuple[str, ...]
    params: Params
    part: str | None = None


@dataclass
class Tree:
    """Nodes in arrays; feature -1 is a leaf. ``sums`` are the whole-number gradient sums, ``own`` a quantile fit's value
    in whole units where it is known."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)
    own: list[float | None] = field(default_factory=list)

    def add(self, rows: int = 0, sums: int = 0, own: float | None = None) -> int:
        for column, start in zip(self.__dict__.values(), (-1, 0, True, -1, -1, 0.0, 0.0, rows, sums, own), strict=True):
            column.append(start)
        return len(self.value) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int32, np.int32, bool, np.int32, np.int32, float)
        return tuple(np.array(c, dtype=k) for c, k in zip(list(self.__dict__.values())[:6], kinds, strict=True))

    def set_values(self, params: "Params", unit: float) -> None:
        """Leaf values in target units, from the sums or from what is known of a quantile fit."""
        if params.quantile is None:
            self.value = [s * unit / (n + params.l2) if n else 0.0 for s, n in zip(self.sums, self.rows, strict=True)]
        else:
            self.value = [0.0 if v is None else v * unit for v in self.own]

    def best_first(self, leaves: int) -> "Tree":
        """The tree of at most ``leaves`` leaves that splits by largest gain first."""
        out, heap = Tree(), []

        def take(node: int) -> int:
            k = out.add(self.rows[node], self.sums[node], self.own[node])
            if self.feature[node] >= 0:
                heapq.heappush(heap, (-self.gain[node], k, node))
            return k

        take(0)
        for _ in range(leaves - 1):
            if not heap:
                break
            _, k, node = heapq.heappop(heap)
            out.feature[k], out.cut[k], out.missing_left[k] = self.feature[node], self.cut[node], self.missing_left[node]
            out.gain[k] = self.gain[node]
            out.left[k], out.right[k] = take(self.left[node]), take(self.right[node])
        return out


def leaf_of(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of each observation; ``bins`` is features by observations, 0 for missing."""
    feature, cut, missing_left, left, right, _ = tree
    at = np.zeros(bins.shape[1], dtype=np.int32)
    while len(inner := np.flatnonzero(feature[at] >= 0)):
        node = at[inner]
        b = bins[feature[node], inner]
        at[inner] = np.where(np.where(b == 0, missing_left[node], b <= cut[node]), left[node], right[node])
    return at


def drawn(params: Params, tree: int, place: np.ndarray) -> np.ndarray:
    """Which rows a tree draws: a mixed hash of seed, tree and the row's place below its share, alike in every task."""
    z = place ^ np.random.SeedSequence([params.seed, tree]).generate_state(1, np.uint64)[0]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < params.row_share


def places(chunk: int, rows: np.ndarray) -> np.ndarray:
    """A number for each row of a chunk, its own among all chunks."""
    return rows.astype(np.uint64) + np.uint64((chunk * 0x9E3779B97F4A7C15) % 2**64)


def best_split(g: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[float, int, int, bool] | None:
    """gain, feature, cut, missing_left from gradient sums and row counts by (feature, bin), bin 0 for missing."""
    total, size = float(g[0].sum()), int(n[0].sum())
    best = None
    for missing_left in (True, False) if n[:, 0].any() else (True,):
        left = np.cumsum(g[:, 1:], axis=1) + (g[:, :1] if missing_left else 0)
        left_n = np.cumsum(n[:, 1:], axis=1) + (n[:, :1] if missing_left else 0)
        gain = left**2 / (left_n + l2) + (total - left) ** 2 / (size - left_n + l2) - total**2 / (size + l2)
        gain = np.where((left_n >= least) & (size - left_n >= least), gain, -np.inf)
        at = int(gain.argmax())
        if gain.flat[at] > 1e-9 and (best is None or gain.flat[at] > best[0]):
            best = (float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1] + 1, missing_left)
    return best


def histograms(bins: np.ndarray, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Gradient sums and row counts of some rows by (feature, bin): two by features by bins.

    Many rows are counted feature by feature, which stays in the cache; few rows all at once, which saves calls.
    """
    k, width, own = len(bins), BINS + 1, g[rows]
    if len(rows) < AT_ONCE:
        flat = (bins[:, rows] + np.arange(k)[:, None] * width).ravel()
        made = np.bincount(flat, np.tile(own, k), k * width), np.bincount(flat, minlength=k * width)
        return np.stack(made).reshape(2, k, width)  # whole numbers below 2**53
    out = np.empty((2, k, width))
    for j in range(k):
        b = bins[j].take(rows).astype(np.intp)
        out[0, j], out[1, j] = np.bincount(b, own, width), np.bincount(b, minlength=width)
    return out


def interpolated(values: np.ndarray, q: float) -> float:
    """The linearly interpolated quantile of whole numbers."""
    at = (len(values) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    both = np.partition(values, (low, high))
    return float(both[low] + (both[high] - both[low]) * (at - low))


def subtree(bins: np.ndarray, left: np.ndarray, params: Params, unit: float, depth: int) -> list[list]:
    """[feature, cut, missing_left, gain, left node, right node, gradient sum, rows, own] of a node's whole subtree.

    bins: allowed features by rows; left: what each row has left to explain. Features count among the allowed ones. Of
    two children only the smaller is counted, the other is the rest: sums of whole numbers lose nothing by that.
    """
    out, g = [], gradients(left, params).astype(float)

    def sums(rows: np.ndarray) -> np.ndarray:
        return histograms(bins, rows, g)

    def tested(rows: np.ndarray, depth: int) -> bool:
        return depth > 0 and len(rows) >= 2 * params.least

    everything = np.arange(len(left))
    work = [(everything, depth, None, sums(everything) if tested(everything, depth) else None)]
    while work:
        rows, depth, parent, hist = work.pop()
        own = None if params.quantile is None else interpolated(left[rows], params.quantile)
        out.append([-1, 0, True, 0.0, -1, -1, int(g[rows].sum()), len(rows), own])
        if parent:
            out[parent[0]][parent[1]] = len(out) - 1
        if tested(rows, depth) and (split := best_split(hist[0] * unit, hist[1], params.least, params.l2)):
            gain, feature, cut, missing_left = split
            out[-1][:4] = [feature, cut, missing_left, gain]
            b, here = bins[feature, rows], len(out) - 1
            go = np.where(b == 0, missing_left, b <= cut)
            parts = [rows[~go], rows[go]]
            small = int(len(parts[1]) < len(parts[0]))
            counted: list = [None, None]
            if any(tested(p, depth - 1) for p in parts):
                counted[small] = sums(parts[small])
                counted[1 - small] = hist - counted[small]
            work += [(parts[i], depth - 1, (here, 5 - i), counted[i]) for i in range(2)]
    return out


def gradients(left: np.ndarray, params: Params) -> np.ndarray:
    """Whole-number gradients: what is left itself, or the slope of the pinball loss."""
    q = params.quantile
    return left if q is None else np.rint(np.where(left > 0, q, q - 1) * (1 << UNIT_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Setup:
    """What every task knows: the fits, all features, and per key the unit of its gradients."""

    fits: tuple[Fit, ...]
    features: tuple[str, ...]
    parts: tuple[str, ...]
    units: tuple[float, ...]

    def of(self, fit: int) -> tuple[int, Fit]:
        return fit // len(self.fits), self.fits[fit % len(self.fits)]

    def unit(self, fit: int) -> float:
        """Of the fit's gradients."""
        key, one = self.of(fit)
        return self.units[key] if one.params.quantile is None else 2.0**-UNIT_BITS

    def own(self, fit: int) -> np.ndarray:
        """The features of a fit, ascending."""
        return np.sort(np.array([self.features.index(c) for c in self.of(fit)[1].features], dtype=np.int64))

    def columns(self, fit: int, tree: int) -> np.ndarray:
        """The features that a tree may use."""
        _, f = self.of(fit)
        own = np.array([self.features.index(c) for c in f.features])
        take = np.random.default_rng([f.params.seed, tree]).permutation(len(own))
        return np.sort(own[take[: max(1, round(f.params.column_share * len(own)))]])


class View:
    """A chunk's observations as a fit sees them at a tree."""

    def __init__(self, setup: Setup, row: dict):
        self.setup, self.key, self.chunk, self.n = setup, row["key"], row["chunk"], row["n"]
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, self.n)
        self.y = np.frombuffer(row["y"], np.float64)
        self.parts = np.frombuffer(row["parts"], bool).reshape(-1, self.n)
        self.score = np.frombuffer(row["score"], np.float64).reshape(-1, self.n)

    def now(self, s: int, since: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        score, rate = self.score[s], self.setup.fits[s].params.rate
        for tree in since:
            score = score + rate * tree[5][leaf_of(self.bins, tree)]
        return score

    def mine(self, s: int, tree: int) -> np.ndarray:
        """The training rows that the tree draws."""
        fit = self.setup.fits[s]
        rows = np.flatnonzero(self.parts[self.setup.parts.index(fit.part)]) if fit.part else np.arange(self.n)
        if fit.params.row_share < 1 and tree >= 0:
            rows = rows[drawn(fit.params, tree, places(self.chunk, rows))]
        return rows

    def left(self, s: int, rows: np.ndarray, since: list) -> np.ndarray:
        """What is left to explain, in whole units."""
        return np.rint((self.y - self.now(s, since))[rows] / self.setup.units[self.key]).astype(np.int64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _table(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for (_, k), v in zip(named, columns, strict=True)], [n for n, _ in named])


class _Sums:
    """Sums by key that a task hands on when they outgrow HELD bytes."""

    def __init__(self, schema: str):
        self.schema, self.of, self.size = schema, {}, 0

    def add(self, key: tuple, value: np.ndarray) -> None:
        if key in self.of:
            self.of[key] += value
        else:
            self.of[key] = value
            self.size += value.nbytes

    def taken(self) -> pa.RecordBatch:
        keys = list(zip(*self.of, strict=True))
        out = _table(self.schema, [*map(list, keys), [v.tobytes() for v in self.of.values()]])
        self.of, self.size = {}, 0
        return out


SUMS = "fit int, node int, sums binary"
SPLITS = "fit int, node int, sub int, feature int, cut int, missing_left boolean, gain double, left int, right int, total long, size long, own double, left_sum long, left_rows long"


def _splits(chunks: DataFrame, setup: Setup, tree: int, level: int, frontier: dict[int, list[int]], trees: dict[int, Tree], since: dict[int, list]) -> list:
    """The best cut of every frontier node of every fit, or all cuts below a node of few rows: one job."""
    near = {(f, k) for f, nodes in frontier.items() for k in nodes if trees[f].rows[k] <= NEAR}
    shared = chunks.sparkSession.sparkContext.broadcast(
        (setup, frontier, {f: trees[f].arrays() for f in frontier}, since, {f: setup.columns(f, tree) for f in frontier}, near)
    )

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setup, frontier, growing, since, columns, near = shared.value
        held, width, whole, size = _Sums(SUMS), BINS + 1, [], 0
        for row in _rows(batches):
            view = View(setup, row)
            for s in range(len(setup.fits)):
                f = view.key * len(setup.fits) + s
                if f not in frontier:
                    continue
                rows = view.mine(s, tree)
                slot = np.full(len(growing[f][0]), -1, dtype=np.int64)
                slot[frontier[f]] = np.arange(len(frontier[f]))
                place = slot[leaf_of(view.bins[:, rows], growing[f])]
                rows, place = rows[place >= 0], place[place >= 0]
                if not len(rows):
                    continue
                left, k, bins = view.left(s, rows, since.get(f, [])), len(columns[f]), view.bins[columns[f]][:, rows]
                far = np.array([(f, node) not in near for node in frontier[f]])
                for j in np.unique(place[~far[place]]).tolist():
                    mine = place == j
                    whole.append((f, frontier[f][j], left[mine].tobytes() + bins[:, mine].T.tobytes()))
                    size += len(whole[-1][2])
                if far.any():
                    some, nodes = np.flatnonzero(far[place]), len(frontier[f])
                    g, slots = gradients(left[some], setup.fits[s].params).astype(float), place[some] * width
                    both = np.empty((2, k, nodes * width), dtype=np.int64)
                    for j in range(k):
                        at = slots + bins[j].take(some)
                        both[0, j] = np.bincount(at, g, nodes * width)  # whole numbers below 2**53: exact
                        both[1, j] = np.bincount(at, minlength=nodes * width)
                    both = both.reshape(2, k, nodes, width)
                    for j in np.flatnonzero(far).tolist():
                        held.add((f, frontier[f][j]), both[:, :, j].reshape(2, -1))
            if held.size > HELD:
                yield held.taken()
            if size > HELD:
                yield _table(SUMS, [list(c) for c in zip(*whole, strict=True)])
                whole, size = [], 0
        if held.of:
            yield held.taken()
        if whole:
            yield _table(SUMS, [list(c) for c in zip(*whole, strict=True)])

    def choose(table: pa.Table) -> pa.Table:
        setup, _, _, _, columns, near = shared.value
        f, node = table.column("fit")[0].as_py(), table.column("node")[0].as_py()
        params, own, parts = setup.of(f)[1].params, columns[f], [x.as_py() for x in table.column("sums")]
        if (f, node) in near:
            k = len(own)
            counts = [len(p) // (8 + k) for p in parts]
            left = np.concatenate([np.frombuffer(p, np.int64, n) for p, n in zip(parts, counts, strict=True)])
            bins = np.concatenate([np.frombuffer(p, np.uint8, n * k, 8 * n).reshape(n, k) for p, n in zip(parts, counts, strict=True)])
            made = subtree(np.ascontiguousarray(bins.T), left, params, setup.unit(f), params.depth - level)
            rows = [[f, node, i, int(own[r[0]]) if r[0] >= 0 else -1, *r[1:], None, None] for i, r in enumerate(made)]
        else:
            total = sum(np.frombuffer(p, np.int64) for p in parts).reshape(2, len(own), -1)
            gain, at, cut, missing_left = best_split(total[0] * setup.unit(f), total[1], params.least, params.l2) or (0.0, -1, 0, True)
            left = total[:, max(at, 0), (0 if missing_left else 1) : cut + 1].sum(axis=1).tolist()
            rows = [[f, node, 0, int(own[at]) if at >= 0 else -1, cut, missing_left, gain, -1, -1, *total[:, 0].sum(axis=1).tolist(), None, *left]]
        return pa.Table.from_batches([_table(SPLITS, [list(c) for c in zip(*rows, strict=True)])])

    found = chunks.mapInArrow(partial, SUMS).groupBy("fit", "node").applyInArrow(lambda table: choose(table), SPLITS).collect()
    shared.destroy()
    return found


def _grown(chunks: DataFrame, setup: Setup, tree: int, sizes: dict[int, int], since: dict[int, list]) -> dict[int, Tree]:
    """A tree of each fit of ``sizes`` (training rows at most), a job a level at most."""
    trees = {f: Tree() for f in sizes}
    for f, t in trees.items():
        t.add(sizes[f])
    frontier = {f: [0] for f in sizes}
    for level in range(max(setup.of(f)[1].params.depth for f in sizes)):
        frontier = {f: nodes for f, nodes in frontier.items() if nodes and level < setup.of(f)[1].params.depth}
        if not frontier:
            break
        following: dict[int, list[int]] = {f: [] for f in frontier}
        found = _splits(chunks, setup, tree, level, frontier, trees, since)
        index: dict[tuple[int, int, int], int] = {}
        for r in found:
            t, key = trees[r["fit"]], (r["fit"], r["node"], r["sub"])
            index[key] = r["node"] if r["sub"] == 0 else t.add()
            k = index[key]
            t.rows[k], t.sums[k], t.own[k] = r["size"], r["total"], r["own"]
            if r["feature"] >= 0:
                t.feature[k], t.cut[k], t.missing_left[k], t.gain[k] = r["feature"], r["cut"], r["missing_left"], r["gain"]
        for r in found:
            f, t = r["fit"], trees[r["fit"]]
            k = index[f, r["node"], r["sub"]]
            if r["feature"] >= 0 and r["left"] >= 0:
                t.left[k], t.right[k] = index[f, r["node"], r["left"]], index[f, r["node"], r["right"]]
            elif r["feature"] >= 0:
                t.left[k] = t.add(r["left_rows"], r["left_sum"])
                t.right[k] = t.add(r["size"] - r["left_rows"], r["total"] - r["left_sum"])
                least = 2 * setup.of(f)[1].params.least
                following[f] += [x for x in (t.left[k], t.right[k]) if t.rows[x] >= least]
        frontier = following
    done = {f: t.best_first(setup.of(f)[1].params.leaves) for f, t in trees.items()}
    for f, t in done.items():
        key, one = setup.of(f)
        t.set_values(one.params, setup.units[key])
    return done


NARROW = "fit int, leaf int, side int, values binary"
NARROWED = "fit int, leaf int, side int, lo long, hi long, rank long, size long"


def _leaf_quantiles(chunks: DataFrame, setup: Setup, tree: int, trees: dict[int, Tree], since: dict[int, list]) -> None:
    """Set the leaves of quantile fits to the exact, linearly interpolated quantile of their rows.

    Each leaf asks for two neighbouring ranks. A step counts the values of an interval in STEPS parts and goes on in the
    part that has the rank; an interval of at most FEW values comes to one task, one of a single number needs none.
    """
    reach = 1 << (UNIT_BITS + 10)
    asked: dict[tuple[int, int, int], tuple[int, int, int, int]] = {}
    place: dict[tuple[int, int], float] = {}
    for f, t in trees.items():
        for leaf in (k for k in range(len(t.feature)) if t.feature[k] < 0 and t.rows[k] and t.own[k] is None):
            n, q = t.rows[leaf], setup.of(f)[1].params.quantile
            place[f, leaf] = (n - 1) * q
            for side, rank in enumerate((int(np.floor(place[f, leaf])), int(np.ceil(place[f, leaf])))):
                asked[f, leaf, side] = (-reach, reach, rank, n)
    found: dict[tuple[int, int, int], int] = {}
    sc = chunks.sparkSession.sparkContext
    while asked:
        shared = sc.broadcast((setup, {f: trees[f].arrays() for f, _, _ in asked}, since, asked))

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            setup, growing, since, asked = shared.value
            held, by_fit, few = _Sums(NARROW), {}, []
            for (f, leaf, side), interval in asked.items():
                by_fit.setdefault(f, []).append((leaf, side, *interval))
            for row in _rows(batches):
                view = View(setup, row)
                for s in range(len(setup.fits)):
                    f = view.key * len(setup.fits) + s
                    if f not in by_fit:
                        continue
                    rows = view.mine(s, tree)
                    at, left = leaf_of(view.bins[:, rows], growing[f]), view.left(s, rows, since.get(f, []))
                    for leaf, side, lo, hi, _, size in by_fit[f]:
                        own = left[(at == leaf) & (left >= lo) & (left <= hi)]
                        if not len(own):
                            continue
                        if size <= FEW:
                            few.append((f, leaf, side, own.tobytes()))
                        else:
                            step = -(-(hi - lo + 1) // STEPS)
                            held.add((f, leaf, side), np.bincount((own - lo) // step, minlength=STEPS))
                if held.size > HELD:
                    yield held.taken()
                if len(few) > 10_000:
                    yield _table(NARROW, [list(c) for c in zip(*few, strict=True)])
                    few = []
            if held.of:
                yield held.taken()
            if few:
                yield _table(NARROW, [list(c) for c in zip(*few, strict=True)])

        def narrow(table: pa.Table) -> pa.Table:
            key = tuple(table.column(c)[0].as_py() for c in ("fit", "leaf", "side"))
            lo, hi, rank, size = shared.value[3][key]
            parts = [np.frombuffer(x.as_py(), np.int64) for x in table.column("values")]
            if size <= FEW:
                lo = hi = int(np.partition(np.concatenate(parts), rank)[rank])
            else:
                counts, step = sum(parts), -(-(hi - lo + 1) // STEPS)
                upto = np.cumsum(counts)
                k = int(np.searchsorted(upto, rank, side="right"))
                rank, size = rank - int(upto[k] - counts[k]), int(counts[k])
                lo, hi = lo + k * step, min(hi, lo + (k + 1) * step - 1)
            return pa.Table.from_batches([_table(NARROWED, [[v] for v in (*key, lo, hi, rank, size)])])

        narrowed = chunks.mapInArrow(partial, NARROW).groupBy("fit", "leaf", "side").applyInArrow(lambda t: narrow(t), NARROWED).collect()
        shared.destroy()
        asked = {}
        for r in narrowed:
            if r["lo"] == r["hi"]:
                found[r["fit"], r["leaf"], r["side"]] = r["lo"]
            else:
                asked[r["fit"], r["leaf"], r["side"]] = (r["lo"], r["hi"], r["rank"], r["size"])
    for (f, leaf), at in place.items():
        low, high = found[f, leaf, 0], found[f, leaf, 1]
        trees[f].value[leaf] = (low + (high - low) * (at - np.floor(at))) * setup.units[setup.of(f)[0]]


def _scored(chunks: DataFrame, setup: Setup, since: dict[int, list]) -> DataFrame:
    """The chunks with the trees of ``since`` in their scores."""
    shared = chunks.sparkSession.sparkContext.broadcast((setup, since))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setup, since = shared.value
        for batch in batches:
            scores = []
            for row in _rows([batch]):
                view, k = View(setup, row), len(setup.fits)
                scores.append(np.concatenate([view.now(s, since.get(view.key * k + s, [])) for s in range(k)]).tobytes())
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores, pa.binary()))

    return chunks.mapInArrow(run, chunks.schema)


CHUNKS = "key int, chunk long, n int, bins binary, y binary, parts binary, score binary"


def _packed(train: DataFrame, setup: Setup, edges: list[list[np.ndarray]], base: list[list[float]]) -> DataFrame:
    """CHUNKS of the training rows (_number, _y, features, parts)."""
    shared = train.sparkSession.sparkContext.broadcast((setup, edges, base))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setup, edges, base = shared.value
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[pa.Table]] = {}

        def pack(key: int, table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            n, bins = len(table), np.zeros((len(setup.features), len(table)), dtype=np.uint8)
            for j, c in enumerate(setup.features):
                x = table.column(f"_x{j}").to_numpy()
                known = ~np.isnan(x)
                bins[j, known] = 1 + np.searchsorted(edges[key][j], x[known], side="left")
            parts = np.stack([table.column(f"_p{j}").to_numpy() for j in range(len(setup.parts))]) if setup.parts else np.zeros((0, n), bool)
            score = np.repeat(np.array(base[key], dtype=float)[:, None], n, axis=1)
            number += 1
            data = [x.tobytes() for x in (bins, table.column("_y").to_numpy(), parts.astype(bool), score)]
            return _table(CHUNKS, [[v] for v in (key, number, n, *data)])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column("_number").to_numpy()
            for key in np.unique(keys).tolist():
                waiting.setdefault(key, []).append(table.filter(pa.array(keys == key)))
                while sum(map(len, waiting[key])) >= CHUNK:
                    whole = pa.concat_tables(waiting[key])
                    yield pack(key, whole.slice(0, CHUNK))
                    waiting[key] = [whole.slice(CHUNK)]
        for key, tables in waiting.items():
            if len(whole := pa.concat_tables(tables)):
                yield pack(key, whole)

    return train.mapInArrow(run, CHUNKS)


def _points(column: str) -> Column:
    """Evenly spaced order statistics: all values of a column of few."""
    return F.percentile_approx(column, F.array(*[F.lit(i / (4 * BINS)) for i in range(4 * BINS + 1)]), F.lit(10_000)).alias(column)


def _cuts(points: list[float] | None) -> np.ndarray:
    """Cuts between the values of a column of few, or at every fourth point."""
    values = np.unique(np.array([p for p in points or [] if p is not None], dtype=float))
    return values[:-1] if len(values) <= BINS else np.unique(np.array(points)[4 : 4 * BINS : 4])


def _named(keys: list[str], schema: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.select(*keys).schema)


def _node_rows(setup: Setup, edges: list[list[np.ndarray]], f: int, number: int, tree: Tree, rate: float) -> list[tuple]:
    """What NODES has of a tree; its features are numbers of all features."""
    key, one = setup.of(f)
    out = []
    for k, j in enumerate(tree.feature):
        cut = None
        if j >= 0:
            cut = float(edges[key][j][tree.cut[k] - 1]) if tree.cut[k] <= len(edges[key][j]) else float("inf")
        name = setup.features[j] if j >= 0 else None
        value, gain = float(tree.value[k] * rate), float(tree.gain[k])
        out.append((one.model, number, k, name, cut, tree.missing_left[k], tree.left[k], tree.right[k], value, gain))
    return out


OWN = "fit int, place binary, y binary, bins binary"


def _boosted_near(chunks: DataFrame, setup: Setup, edges: list[list[np.ndarray]], base: list[list[float]], fits: list[int]) -> DataFrame:
    """_number and NODES of the fits of few rows: their rows meet once in a task a fit, which grows all trees."""
    shared = chunks.sparkSession.sparkContext.broadcast((setup, edges, base, frozenset(fits)))

    def mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setup, _, _, near = shared.value
        for row in _rows(batches):
            view = View(setup, row)
            for s in range(len(setup.fits)):
                f, rows = view.key * len(setup.fits) + s, view.mine(s, -1)
                if f in near and len(rows):
                    data = places(view.chunk, rows), view.y[rows], view.bins[setup.own(f)][:, rows].T
                    yield _table(OWN, [[f], *[[x.tobytes()] for x in data]])

    def boost(table: pa.Table) -> pa.Table:
        setup, edges, base, _ = shared.value
        f = table.column("fit")[0].as_py()
        (key, one), own = setup.of(f), setup.own(f)
        params, unit = one.params, setup.units[key]
        place, y, bins = [
            np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
            for c, kind in (("place", np.uint64), ("y", np.float64), ("bins", np.uint8))
        ]
        bins = np.ascontiguousarray(bins.reshape(len(y), len(own)).T)
        score = np.full(len(y), base[key][f % len(setup.fits)])
        root = Tree()
        root.add(len(y))
        root.value[0] = float(score[0])
        if params.quantile is not None:
            root.value[0] = interpolated(np.rint((y - score) / unit).astype(np.int64), params.quantile) * unit
            score = score + params.rate * (root.value[0] / params.rate)
        out = _node_rows(setup, edges, f, -1, root, 1.0)
        for number in range(params.trees):
            rows = np.flatnonzero(drawn(params, number, place)) if params.row_share < 1 else np.arange(len(y))
            tree, allowed = Tree(), np.searchsorted(own, setup.columns(f, number))
            if len(rows):
                left = np.rint((y[rows] - score[rows]) / unit).astype(np.int64)
                made = subtree(bins[allowed].take(rows, axis=1), left, params, setup.unit(f), params.depth)
                for feature, cut, missing_left, gain, a, b, sums, size, value in made:
                    k = tree.add(size, sums, value)
                    tree.feature[k], tree.cut[k], tree.missing_left[k] = feature, cut, missing_left
                    tree.gain[k], tree.left[k], tree.right[k] = gain, a, b
                tree = tree.best_first(params.leaves)
            else:
                tree.add()
            tree.set_values(params, unit)
            tree.feature = [int(allowed[j]) if j >= 0 else -1 for j in tree.feature]
            arrays = tree.arrays()
            score = score + params.rate * arrays[5][leaf_of(bins, arrays)]
            tree.feature = [int(own[j]) if j >= 0 else -1 for j in tree.feature]
            out += _node_rows(setup, edges, f, number, tree, params.rate)
        return pa.Table.from_batches([_table("_number int, " + NODES, [[key] * len(out), *map(list, zip(*out, strict=True))])])

    # A partition a fit: left to itself, the small shuffle would be read by one task.
    return chunks.mapInArrow(mine, OWN).repartition(len(fits), "fit").groupBy("fit").applyInArrow(lambda t: boost(t), "_number int, " + NODES)


NODES = "model string, tree int, node int, feature string, cut double, missing_left boolean, left int, right int, value double, gain double"


def fit(train: DataFrame, keys: list[str], fits: list[Fit], target: str = "target") -> DataFrame:
    """keys and NODES of a booster per key and fit, stored. Tree -1 is the base; values include the rate.

    Rows without a target are left out; a key without rows has no model; NULL keys are a key. Cuts lie between quantiles
    of a feature over all training rows of the call. Missing features go to the better side of each cut.
    """
    spark = train.sparkSession
    features = tuple(sorted({c for f in fits for c in f.features}))
    parts = tuple(sorted({f.part for f in fits if f.part}))
    slim = train.filter(F.col(target).isNotNull()).select(
        *keys,
        F.col(target).cast("double").alias("_y"),
        *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)],
        *[F.coalesce(F.col(c), F.lit(False)).alias(f"_p{j}") for j, c in enumerate(parts)],
    )
    if parts and all(f.part for f in fits):
        slim = slim.filter(" OR ".join(f"_p{j}" for j in range(len(parts))))
    slim = kept(slim, "boost-rows")
    path, names = new_path(spark, "boost-nodes"), slim.select(*keys).distinct()
    # A block of keys at a time: its trees, edges and frontier are what the driver and the broadcasts hold.
    block: list = []
    size = max(1, FITS // len(fits))
    for row in names.toLocalIterator():
        block.append(row)
        if len(block) == size:
            _fit_block(slim, keys, block, fits, features, parts, path)
            block = []
    if block:
        _fit_block(slim, keys, block, fits, features, parts, path)
    schema = _named(keys, slim) + NODES
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _fit_block(slim: DataFrame, keys: list[str], block: list, fits: list[Fit], features: tuple, parts: tuple, path: str) -> None:
    spark = slim.sparkSession
    if keys:
        listed = spark.createDataFrame([(*b, i) for i, b in enumerate(block)], _named(keys, slim) + "_number int")
        few = F.broadcast(listed.withColumnsRenamed({k: f"_of_{k}" for k in keys}))  # FITS rows at most
        match = F.lit(True)
        for k in keys:
            match = match & slim[k].eqNullSafe(few[f"_of_{k}"])
        rows = slim.join(few, match).drop(*keys, *[f"_of_{k}" for k in keys])
    else:
        rows = slim.withColumn("_number", F.lit(0))
    counts = [F.count_if(F.col(f"_p{parts.index(f.part)}") if f.part else F.lit(True)).alias(f"_n{i}") for i, f in enumerate(fits)]
    means = [F.avg(F.when(F.col(f"_p{parts.index(f.part)}") if f.part else F.lit(True), F.col("_y"))).alias(f"_m{i}") for i, f in enumerate(fits)]
    facts = {r["_number"]: r for r in rows.groupBy("_number").agg(F.max(F.abs("_y")).alias("top"), *counts, *means, *[_points(f"_x{j}") for j in range(len(features))]).collect()}
    if not facts:  # no rows at all
        return
    order = range(len(block))
    # The unit is a power of two, so that whole units are exact as doubles too.
    units = tuple(2.0 ** (np.ceil(np.log2(facts[k]["top"] or 1.0)) - UNIT_BITS) for k in order)
    setup = Setup(tuple(fits), features, parts, units)
    edges = [[_cuts(facts[k][f"_x{j}"]) for j in range(len(features))] for k in order]
    base = [[np.rint((facts[k][f"_m{i}"] or 0.0) / units[k]) * units[k] if f.params.quantile is None else 0.0 for i, f in enumerate(fits)] for k in order]
    sizes = {f: facts[f // len(fits)][f"_n{f % len(fits)}"] for f in range(len(block) * len(fits))}
    chunks, nears = _packed(rows, setup, edges, base), [f for f, n in sizes.items() if 0 < n <= NEAR]
    trees_of = [f for f, n in sizes.items() if n > NEAR]
    where = new_path(spark, "boost-chunks")
    if trees_of:
        chunks = kept(chunks, "boost-chunks", where).persist()
    if nears:
        made = _boosted_near(chunks, setup, edges, base, nears)
        numbered = spark.createDataFrame([(*b, i) for i, b in enumerate(block)], _named(keys, slim) + "_number int")
        # The broadcast side has FITS rows at most.
        out_nodes = made.join(F.broadcast(numbered), "_number").select(*keys, *made.columns[1:])
        out_nodes.write.mode("append").parquet(path)
    if not trees_of:
        return
    since: dict[int, list] = {}

    def advance() -> None:
        nonlocal chunks, where, since
        old, gone, where, since_now = chunks, where, new_path(spark, "boost-chunks"), since
        chunks = kept(_scored(old, setup, since_now), "boost-chunks", where).persist()
        old.unpersist()
        remove(spark, gone)
        since = {}

    out: list[tuple] = []

    def record(f: int, number: int, tree: Tree, rate: float) -> None:
        out.extend((*block[setup.of(f)[0]], *row) for row in _node_rows(setup, edges, f, number, tree, rate))

    def flush() -> None:
        if out:
            spark.createDataFrame(out, _named(keys, slim) + NODES).coalesce(1).write.mode("append").parquet(path)
            out.clear()

    roots = {}
    for f in trees_of:
        key, one = setup.of(f)
        roots[f] = Tree()
        roots[f].add()
        roots[f].value[0] = base[key][f % len(fits)]
    quantiles = {f: roots[f] for f in trees_of if setup.of(f)[1].params.quantile is not None}
    if quantiles:  # the base of a quantile fit is the quantile of its rows
        for f, t in quantiles.items():
            t.rows[0] = sizes[f]
        _leaf_quantiles(chunks, setup, -1, quantiles, {})
        since = {f: [(*t.arrays()[:5], np.array(t.value) / setup.of(f)[1].params.rate)] for f, t in quantiles.items()}
        advance()
    for f in trees_of:
        record(f, -1, roots[f], 1.0)
    number = 0
    while active := [f for f in trees_of if number < setup.of(f)[1].params.trees]:
        grown = _grown(chunks, setup, number, {f: sizes[f] for f in active}, since)
        bent = {f: t for f, t in grown.items() if setup.of(f)[1].params.quantile is not None}
        if bent:
            _leaf_quantiles(chunks, setup, number, bent, since)
        for f, t in grown.items():
            record(f, number, t, setup.of(f)[1].params.rate)
            since.setdefault(f, []).append(t.arrays())
        number += 1
        if number % STORE == 0:
            flush()
            advance()
    flush()
    chunks.unpersist()
    remove(spark, where)


def load_models(nodes: DataFrame, keys: list[str], models: list[str]) -> dict[tuple, dict[str, tuple]]:
    """key -> model -> (features, trees as arrays): the bounded tables of the named models."""
    rows = nodes.filter(F.col("model").isin(models)).orderBy(*keys, "model", "tree", "node").toArrow().combine_chunks()
    starts = np.flatnonzero(rows.column("node").to_numpy() == 0)  # each tree begins at its root
    ends = np.append(starts, len(rows))[1:]
    coded = pa.chunked_array(rows.column("feature"), pa.string()).combine_chunks().dictionary_encode()
    code, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    kinds = {"cut": float, "missing_left": bool, "left": np.int32, "right": np.int32, "value": float}
    columns = [rows.column(c).to_numpy().astype(k) for c, k in kinds.items()]
    spans: dict[tuple, dict[str, list[tuple[int, int]]]] = {}
    for head, start, end in zip(rows.select([*keys, "model"]).take(starts).to_pylist(), starts, ends, strict=True):
        spans.setdefault(tuple(head[k] for k in keys), {}).setdefault(head["model"], []).append((start, end))
    out: dict[tuple, dict[str, tuple]] = {}
    for key, own in spans.items():
        for model, at in own.items():
            used = np.unique(np.concatenate([code[i:j] for i, j in at]))
            used = used[used >= 0]
            number = np.full(len(names) + 1, -1, dtype=np.int32)  # the last one stands for a leaf, code -1
            number[used] = np.arange(len(used))
            trees = [(number[code[i:j]], *[c[i:j] for c in columns]) for i, j in at]
            out.setdefault(key, {})[model] = ([names[u] for u in used], trees)
    return out


def _walked(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Summed leaf values of observations by features."""
    total = np.zeros(len(x))
    for feature, cut, missing_left, left, right, value in trees:
        at = np.zeros(len(x), dtype=np.int32)
        while len(inner := np.flatnonzero(feature[at] >= 0)):
            node = at[inner]
            v = x[inner, feature[node]]
            at[inner] = np.where(np.where(np.isnan(v), missing_left[node], v <= cut[node]), left[node], right[node])
        total += value[at]
    return total


def predict(rows: DataFrame, keep: list[str], nodes: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """keep and a prediction column per model (NULL where a key has no such model), in the tasks that read the rows.

    ``keys`` are columns of ``rows`` and ``nodes``. The named models' trees are broadcast; name few at a time.
    """
    loaded = load_models(nodes, keys, models)
    wanted = sorted({c for own in loaded.values() for names, _ in own.values() for c in names})
    shared = rows.sparkSession.sparkContext.broadcast(loaded)
    kept_columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)]  # names with dots cannot go in
    kinds = [rows.schema[c].dataType.simpleString() for c in keep]
    slim = rows.select(*kept_columns, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(wanted)])
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in zip(keep, kinds, strict=True)), *(f"`{m}` double" for m in models)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = {c: batch.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j, c in enumerate(wanted)}
            of = list(zip(*[batch.column(f"_k{i}").to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * n
            codes: dict[tuple, int] = {}
            code = np.array([codes.setdefault(k, len(codes)) for k in of], dtype=np.int64)
            made = {m: np.full(n, np.nan) for m in models}
            for key, c in codes.items():
                at = np.flatnonzero(code == c)
                for m, (names, trees) in shared.value.get(key, {}).items():
                    made[m][at] = _walked(np.stack([x[c][at] for c in names], axis=1) if names else np.zeros((len(at), 0)), trees)
            columns = [batch.column(c) for c in range(len(keep))]
            columns += [pa.array(made[m], pa.float64(), mask=np.isnan(made[m])) for m in models]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *models])

    return slim.mapInArrow(run, schema)


def fit_predict(parts: DataFrame, keys: list[str], features: list[str], params: Params, quantiles: dict[str, float] | None = None, name: str = "gbdt", t: str = "utc_start") -> DataFrame:
    """keys, time, target and predictions of the test rows; a booster per key, and per level of ``quantiles`` (column ->
    level). parts: keys, part (train or test), time, target, features. The caller sorts quantiles (sorted_quantiles)."""
    made = {name: params} | {c: replace(params, quantile=q) for c, q in (quantiles or {}).items()}
    nodes = fit(parts.filter("part = 'train'"), keys, [Fit(m, tuple(features), p) for m, p in made.items()])
    test = parts.filter("part = 'test'").withColumn("target", F.col("target").cast("double"))
    return predict(test, [*keys, t, "target"], nodes, keys, list(made))


def importance(nodes: DataFrame, keys: list[str], features: dict[str, list[str]]) -> DataFrame:
    """keys, model, feature, gain: summed gains of each model's features, 0.0 for one that no tree uses."""
    spark = nodes.sparkSession
    named = spark.createDataFrame([(m, c) for m, names in features.items() for c in names], "model string, feature string")
    heads = nodes.filter("tree = -1").select(*keys, "model")
    gains = nodes.filter("feature is not null").groupBy(*keys, "model", "feature").agg(F.sum("gain").alias("gain"))
    every = heads.join(named, "model")
    same: Callable[[str], Column] = lambda c: every[c].eqNullSafe(gains[c])
    match = same("model") & same("feature")
    for k in keys:
        match = match & same(k)
    columns = [every[c] for c in [*keys, "model", "feature"]]
    return every.join(gains, match, "left").select(*columns, F.coalesce(gains["gain"], F.lit(0.0)).alias("gain"))


def gain_importance(train: DataFrame, keys: list[str], features: list[str], params: Params) -> DataFrame:
    """keys, feature, gain of a booster per key."""
    nodes = fit(train, keys, [Fit("gbdt", tuple(features), params)])
    return importance(nodes, keys, {"gbdt": features}).drop("model")
