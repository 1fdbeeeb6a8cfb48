"""Near-duplicates by similar five-word shingle sets, proposed by SimHash vantage-point trees and decided by the sets.

1. Tasks turn every whole text into its set of shingle hashes, a fingerprint of its words, and the first shingles of
   the set in a common order (rarest first). Rows of equal normalised text are one item.
2. The vantage-point search (simhash_vptree.links) proposes a spanning forest of items of close fingerprints.
3. What fingerprints miss is found exactly: two similar sets share one of their first shingles (prefix filter). Of the
   shingles that several items share, a star around the most central of them proposes pairs too, which join most of
   what belongs together; then every pair of items of different components that share one is compared.
4. A proposed pair links if its sets are similar; connected components run over the links in Spark.

Sizes, places of the shared shingle, parity bitmaps and how many first shingles a pair shares are exact bounds that
leave out pairs which cannot be similar: in a large corpus most long texts share one with another by chance, few share
as many as they must. Sets are not kept: those that a pair names are made again from their texts, which a bitmap finds.
Items that share a frequent shingle meet by bands of their sizes: an item goes to the bands of the smaller partners that
its place leaves possible, so pages of a template whose own text keeps them apart meet nobody. What does meet is cut
into chunks, and pairs within the component that most of a band belongs to are never formed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import connected_components
from gridtide.llm.shared import dropped, free_name, stored
from gridtide.llm.simhash_vptree import SEED, fingerprint, links

#: Odd multiplier and finalizer constants of the shingle hash (fixed values of MurmurHash3's 64-bit mix).
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
BITS = 512
#: Rows of a shingle that meet as they are, and of a side of a group where a shingle has more.
CHUNK = 2048
#: Ratio of a band's sizes.
BAND = 1.1
#: Bits that tell which texts a pair names; false members cost work and are joined away.
MARKS = 2**25
#: A pair with the centre of a shingle is proposed if it is the centre of this part of the shingles that they must share.
STAR_PART = 0.25


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, from the words' hashes; a shorter text is one run."""
    n = max(1, min(n, len(words)))
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + words[k : len(words) - n + 1 + k]
    for m in MIX:
        out = (out ^ (out >> np.uint64(33))) * m
    return out ^ (out >> np.uint64(33))


def text_sets(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes of the distinct words, sorted hashes of the distinct shingles, and a digest of the normalised text."""
    words = text.lower().split()
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    return np.unique(each), np.unique(shingle_hashes(each, n)), hashlib.sha256(b" ".join(words)).digest()[:16]


def parity(full: np.ndarray) -> bytes:
    """BITS bits, each the parity of the hashes that fall to it: two sets differ in at least as many as their bitmaps."""
    return np.packbits((np.bincount((full & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def packed(full: np.ndarray) -> bytes:
    """A sorted set by the upper 40 bits of its hashes, whatever its size.

    Two sets are compared only when proposed; shingles that differ but agree in 40 bits are expected n m / 2**40 times
    in a pair of n and m, and one such can matter only at the threshold itself.
    """
    return np.unique(full >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def set_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed sets; two empty sets are equal."""
    x, y = unpacked(a), unpacked(b)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def common_shingles(docs: DataFrame, set_words: int, sample: int = 10_000, times: int = 3, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that stand in ``times`` texts of a sample or more, and in how many.

    They only set the order of shingles (see prefix), so whatever the sample holds, no pair is lost.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(text_sets(text.as_py() or b"", set_words)[1].view(np.int64))], names=["h"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // sample))) == 0).select(F.col("text").cast("binary").alias("text"))
    counted = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= times)
    rows = counted.orderBy(F.desc("count"), "h").limit(most).collect()
    h, n = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(full: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a sorted set, by commonness, then hash: as many as a set ``least`` similar cannot all lack."""
    h, n = common
    count = np.zeros(len(full), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, full), len(h) - 1)
        count = np.where(h[at] == full, n[at], 0)
    return full[np.lexsort((full, count))[: len(full) - int(np.ceil(least * len(full) - 1e-9)) + 1]]


def raw_digest(text: str):
    """SHA-256 of a text as it stands (NULL: empty), a column."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, raw (digest of the text), text (binary) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_digest("text").alias("raw"), F.col("text").cast("binary").alias("text"))


def shingle_sets(docs: DataFrame, set_words: int, least: float) -> DataFrame:
    """row (a number of its own), doc_id, raw (digest of the text), item (digest of the normalised text), fp (of the
    distinct words), n (shingles), bits (parity), prefix of every row."""
    common = common_shingles(docs, set_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, items, sizes, bits, firsts = [], [], [], [], []
            for text in batch.column(2):
                # Word variety, not word frequency: a replaced word moves few bits, and the set decides.
                words, full, item = text_sets(text.as_py() or b"", set_words)
                prints.append(fingerprint(words))
                items.append(item)
                sizes.append(len(full))
                bits.append(parity(full))
                firsts.append(prefix(full, common, least).astype("<u8").tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(items, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (bits, firsts))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "raw", "item", "fp", "n", "bits", "prefix"])

    sets = text_rows(docs).mapInArrow(run, "doc_id long, raw binary, item binary, fp long, n int, bits binary, prefix binary")
    return sets.withColumn("row", F.monotonically_increasing_id())


def named_sets(named: DataFrame, docs: DataFrame, set_words: int) -> DataFrame:
    """id, shingles (packed) of the items ``named`` (id, doc_id, raw), made from their texts in one pass over ``docs``.

    A bitmap, in pieces of 4 KB, tells which ids (of rows without one: which texts) are named. What it lets through is
    joined exactly.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [packed(text_sets(text.as_py() or b"", set_words)[1]) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "raw", "shingles"])

    def mark(doc_id, raw):
        return F.pmod(F.when(doc_id.isNull(), F.xxhash64(raw)).otherwise(F.xxhash64(doc_id)), F.lit(MARKS))

    piece, bit = F.shiftright("at", 15), F.pmod("at", F.lit(1 << 15))
    marks = named.select(mark(F.col("doc_id"), F.col("raw")).alias("at")).groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("at", mark(F.col("doc_id"), raw_digest("text")))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = texts.join(F.broadcast(marks), piece == F.col("piece")).filter(F.floor(byte / F.pow(F.lit(2), F.pmod("at", F.lit(8)))) % 2 == 1)
    made = text_rows(some).mapInArrow(run, "doc_id long, raw binary, shingles binary")
    mine = made.join(named.hint("merge"), made["doc_id"].eqNullSafe(named["doc_id"]) & (made["raw"] == named["raw"])).select("id", "shingles")
    return mine.groupBy("id").agg(F.first("shingles").alias("shingles"))  # rows may repeat


def similar(pairs: DataFrame, items: DataFrame, docs: DataFrame, set_words: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: ids of ``items``) whose sets are ``least`` similar.

    The joins that bring two sets together carry those alone that the pairs name. What they join grows with the corpus,
    so merge hints keep the plan alike at every size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [set_similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    named = stored(items.select("id", "rep.doc_id", "rep.raw").join(ids, "id", "left_semi"), "named")
    some = stored(named_sets(named, docs, set_words), "pair-sets")
    x = some.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = some.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    links = stored(pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar")
    dropped(named)
    dropped(some)
    return links


def must_share(total, larger, least: float, ceil):
    """How many shingles of their prefixes sets of ``total`` shingles share if they are ``least`` similar, ``larger`` in the larger.

    Such sets have at least a shingles in common. Leave out the last a - k of each set: k or more of the common ones are
    left in each, the same k first ones. The largest k is returned for which the prefixes hold all that is left.
    ``ceil``: NumPy's or Spark's.
    """
    return ceil(total * (least / (1 + least)) - 1e-6) - ceil(larger * least - 1e-9) + 1


def with_component(items: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``items`` (id, ...) with their component over all links ``found``; one without links is its own."""
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    of = connected_components(edges, "links").withColumnRenamed("node", "id")
    return items.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))


def spread(firsts: DataFrame, places: bool) -> DataFrame:
    """A row per item and prefix shingle of ``firsts`` (id, prefix): token and, with ``places``, id and place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = pa.array(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8"))
            if not places:
                yield pa.RecordBatch.from_arrays([token], names=["token"])
                continue
            many = pc.binary_length(batch.column(1)).to_numpy() // 8
            mine = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), many)))
            at = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([token, mine, pa.array(at.astype(np.int32))], names=["token", "id", "place"])

    return firsts.select("id", "prefix").mapInArrow(run, "token long, id long, place int" if places else "token long")


def may_link(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], least: float) -> np.ndarray:
    """Which pairs of (n, place, bits as words) the exact bounds leave open.

    The first token that two sets share leaves them at most the shingles from there on in common, so a pair that its
    token rules out comes from an earlier one or not at all.
    """
    (n, at, bits), (m, to, more) = a, b
    total = n + m
    fit = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6
    fit &= np.minimum(n - at, m - to) >= least / (1 + least) * total - 1e-6
    some = np.flatnonzero(fit)
    apart = np.bitwise_count(bits[some] ^ more[some]).sum(axis=1)
    fit[some] = apart <= (1 - least) / (1 + least) * total[some] + 1e-6
    return fit


def _blocks(many: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, number within the owner's) of ``many[i]`` things of each owner i, about ``cells`` at a time."""
    left = np.flatnonzero(many > 0)
    total, k = np.cumsum(many[left]), 0
    while k < len(left):
        stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + cells, "right")))
        mine = left[k:stop]
        i = np.repeat(mine, many[mine])
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
        k = stop


def token_pairs(group: np.ndarray, ids: np.ndarray, component: np.ndarray, size: np.ndarray, at: np.ndarray, bits: np.ndarray, least: float, cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of id pairs of one group and different components that may link. Rows are sorted by group, then component."""
    if not len(group):
        return
    new = group[1:] != group[:-1]
    starts = np.flatnonzero(np.append(True, new))
    parts = np.flatnonzero(np.append(True, new | (component[1:] != component[:-1])))
    end = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
    after = np.repeat(np.append(parts[1:], len(group)), np.diff(np.append(parts, len(group))))
    for i, j in _blocks(end - after, cells):
        j = j + after[i]
        fit = may_link((size[i], at[i], bits[i]), (size[j], at[j], bits[j]), least)
        a, b = np.minimum(ids[i], ids[j])[fit], np.maximum(ids[i], ids[j])[fit]
        if len(a):
            yield a, b


def band_pairs(home: np.ndarray, reach: np.ndarray, ids: np.ndarray, component: np.ndarray, size: np.ndarray, at: np.ndarray, bits: np.ndarray, least: float, cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of id pairs of a seeker and an item at home, of different components, that may link; one group's rows."""
    q, h = np.flatnonzero(~home), np.flatnonzero(home)
    h = h[np.argsort(size[h], kind="stable")]
    low = np.searchsorted(size[h], np.ceil(least * size[q] - 1e-6), "left")
    high = np.searchsorted(size[h], reach[q], "right")
    for i, j in _blocks(high - low, cells):
        i, j = q[i], h[j + low[i]]
        apart = component[i] != component[j]
        i, j = i[apart], j[apart]
        fit = may_link((size[i], at[i], bits[i]), (size[j], at[j], bits[j]), least)
        a, b = np.minimum(ids[i], ids[j])[fit], np.maximum(ids[i], ids[j])[fit]
        if len(a):
            yield a, b


def shared_tokens(sets: DataFrame, items: DataFrame) -> DataFrame:
    """token, id, place of every prefix shingle that stands in two items or more, stored."""
    firsts = sets.select(F.col("row").alias("id"), "prefix").join(items.select("id"), "id", "left_semi")
    twice = stored(spread(firsts, False).groupBy("token").count().filter("count > 1").select("token"), "shared-shingles")
    tokens = stored(spread(firsts, True).join(twice, "token", "left_semi"), "tokens")
    dropped(twice)
    return tokens


def star_pairs(tokens: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """a, b: each item with the most central item of its shared tokens, where their sizes allow it, stored.

    Central is what has least of its prefix to itself: the text that the others are edits of. A text that is central to
    few of the tokens that the two must share stands there by chance; if not, open_pairs finds the pair.
    """
    own = tokens.groupBy("id").agg(F.count("*").alias("shared")).join(items.select("id", "n"), "id")
    own = own.select("id", "n", F.struct((-F.col("shared") / F.col("n")).alias("lone"), F.col("id").alias("id"), F.col("n").alias("n")).alias("rank"))
    placed = stored(tokens.select("token", "id").join(own, "id"), "star-shingles")
    first = placed.groupBy("token").agg(F.min("rank").alias("hub"))
    rays = placed.join(first, "token").filter(F.least("n", "hub.n") >= least * F.greatest("n", "hub.n") - 1e-6)
    k = must_share(F.col("n") + F.col("hub.n"), F.greatest("n", "hub.n"), least, F.ceil)
    pairs = rays.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"), k.alias("k")).filter("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("rays"), F.max("k").alias("k"))
    stars = stored(counted.filter(F.col("rays") >= F.col("k") * STAR_PART).select("a", "b"), "stars")
    dropped(placed)
    return stars


def possible(pairs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and parity bitmaps leave open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zero = np.zeros(batch.num_rows, np.int64)
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            bits, more = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for c in ("bits", "more"))
            yield batch.select(["a", "b"]).filter(pa.array(may_link((n, zero, bits), (m, zero, more), least)))

    x = items.select(F.col("id").alias("a"), "n", "bits")
    y = items.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("more"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "bits", "more").mapInArrow(run, "a long, b long")


MET = ["token", "cell", "component", "home", "id", "n", "place", "reach", "bits"]


def _in_bands(many: DataFrame, least: float) -> tuple[DataFrame, int]:
    """MET rows of frequent shingles, and about how many. Each pair that may link meets where its smaller item is at home.

    A band's largest component is told apart: seekers outside it meet all at home, its own seekers only the others.
    """

    def band(n):
        return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")

    low = F.ceil(F.col("n") * least - 1e-6)
    seekers = many.filter(F.col("reach") >= low).withColumn("band", F.explode(F.sequence(band(low), band(F.col("reach")))))
    homes = many.withColumn("band", band(F.col("n")))
    each = seekers.select("token", "band", "component", F.lit(1).alias("p"), F.lit(0).alias("h"))
    each = each.union(homes.select("token", "band", "component", F.lit(0).alias("p"), F.lit(1).alias("h")))
    parts = each.groupBy("token", "band", "component").agg(F.sum("p").alias("p"), F.sum("h").alias("h"))
    top = F.max(F.struct((F.col("p") + F.col("h")).alias("rows"), "component", "p", "h")).alias("top")
    cells = parts.groupBy("token", "band").agg(F.sum("p").alias("p"), F.sum("h").alias("h"), top)
    others, rest = F.col("p") - F.col("top.p"), F.col("h") - F.col("top.h")

    def chunks(n, other):
        return F.when((n > 0) & (other > 0), F.ceil(n / CHUNK)).otherwise(0).cast("int")

    sides = {"p0": chunks(others, F.col("h")), "h0": chunks(F.col("h"), others), "p1": chunks(F.col("top.p"), rest), "h1": chunks(rest, F.col("top.p"))}
    cells = cells.select("token", "band", F.col("top.component").alias("most"), *[c.alias(n) for n, c in sides.items()], (others * sides["h0"] + F.col("h") * sides["p0"] + F.col("top.p") * sides["h1"] + rest * sides["p1"]).alias("rows"))
    cells = stored(cells.filter("p0 + p1 > 0"), "bands")
    turn = F.xxhash64("id")

    def dealt(kind: int, mine: str, other: str, home: bool):
        """The groups of a row of one side: its own chunk with every chunk of the other side."""
        own, all_of = F.pmod(turn, F.greatest(F.col(mine), F.lit(1))), F.sequence(F.lit(0), F.col(other) - 1)

        def name(k):
            p, h = (k, own) if home else (own, k)
            return ((F.col("band") * 2 + kind).cast("long") * (1 << 20) + p) * (1 << 20) + h

        return F.when((F.col(mine) > 0) & (F.col(other) > 0), F.transform(all_of, name)).otherwise(F.array().cast("array<bigint>"))

    inside = F.col("component") == F.col("most")
    seeking = seekers.join(cells, ["token", "band"]).withColumn("to", F.when(inside, dealt(1, "p1", "h1", False)).otherwise(dealt(0, "p0", "h0", False)))
    at_home = homes.join(cells, ["token", "band"])
    at_home = at_home.withColumn("to", F.concat(dealt(0, "h0", "p0", True), F.when(inside, F.array().cast("array<bigint>")).otherwise(dealt(1, "h1", "p1", True))))
    both = seeking.withColumn("home", F.lit(False)).unionByName(at_home.withColumn("home", F.lit(True)))
    return both.withColumn("cell", F.explode("to")).select(*MET), cells.agg(F.sum("rows")).first()[0] or 0


def open_pairs(tokens: DataFrame, items: DataFrame, least: float, rows_per_part: int = 200_000) -> DataFrame:
    """a, b: every pair of items of different components that shares as many tokens as it must and may link, stored.

    Tokens of at most CHUNK rows are counted for each pair. Of the others, whose pairs are not all formed, a pair is
    taken to share as many as the item that has fewer of them.
    """
    named = tokens.join(items.select("id", "component", "n"), "id")
    counts = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    counts = stored(counts.filter("low <> high").select("token", "rows"), "open-shingles")
    reach = F.floor((F.col("n") - F.col("place") + 1e-6) * ((1 + least) / least) - F.col("n") + 1e-9)  # the largest partner
    rows = named.join(counts, "token").join(items.select("id", "bits"), "id").withColumn("reach", F.least("n", reach).cast("int"))
    many = stored(rows.filter(F.col("rows") > CHUNK).drop("rows"), "frequent-shingles")
    banded, size = _in_bands(many, least)
    few = rows.filter(F.col("rows") <= CHUNK).withColumn("cell", F.lit(-1).cast("long")).withColumn("home", F.lit(True)).select(*MET)
    size += counts.filter(F.col("rows") <= CHUNK).agg(F.sum("rows")).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last group, which the next batch may continue
        made: list[np.ndarray] = []  # a, b, shared, hit, k of pairs not yet given out, which meet in many shingles

        def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
            token, cell, component, home, ids, n, place, reach = (table.column(c).to_numpy().astype(np.int64) for c in MET[:8])
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
            group = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))

            def named(i: np.ndarray, j: np.ndarray, shared: int) -> np.ndarray:
                total, k = n[i] + n[j], must_share(n[i] + n[j], np.maximum(n[i], n[j]), least, np.ceil).astype(np.int64)
                hit = np.minimum(n[i] - place[i], n[j] - place[j]) >= least / (1 + least) * total - 1e-6
                return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.full(len(i), shared), hit, k], axis=1)

            at = np.flatnonzero(cell < 0)  # a place rules a pair out only by its first token, so all tokens are counted
            for i, j in token_pairs(*(x[at] for x in (group, np.arange(len(ids)), component, n, np.zeros_like(place), bits)), least):
                yield named(i, j, 1)
            for g in np.unique(group[cell >= 0]):
                at = np.flatnonzero(group == g)
                for i, j in band_pairs(*(x[at] for x in (home > 0, reach, np.arange(len(ids)), component, n, place, bits)), least):
                    yield named(i, j, 0)

        def given(most: int) -> Iterator[pa.RecordBatch]:
            """What has been made, each pair once, if it is more than ``most``; the rest waits for more of the same."""
            if sum(map(len, made)) > most:
                every = np.concatenate(made)
                every = every[np.lexsort((every[:, 1], every[:, 0]))]
                first = np.flatnonzero(np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1)))
                once = every[first]
                once[:, 2], once[:, 3] = np.add.reduceat(every[:, 2], first), np.maximum.reduceat(every[:, 3], first)
                made[:] = [once]
                if len(once) > most // 2:
                    made.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(once[:, c])) for c in range(5)], names=["a", "b", "shared", "hit", "k"])

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for p in pairs(table):
                made.append(p)
                yield from given(200_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(2)]
            if held and last == [held[0].column(c)[0].as_py() for c in range(2)]:  # all of it continues the held group
                held.append(batch)
                continue
            same = [batch.column(c).to_numpy() == last[c] for c in range(2)]
            cut = int(np.argmax(same[0] & same[1]))
            yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from found(pa.Table.from_batches(held))
        yield from given(0)

    parts = max(8, -(-size // rows_per_part))
    near = few.unionByName(banded).repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "component")
    counted = near.mapInArrow(run, "a long, b long, shared long, hit long, k long").groupBy("a", "b")
    counted = counted.agg(F.sum("shared").alias("shared"), F.max("hit").alias("hit"), F.max("k").alias("k")).filter("hit > 0").drop("hit")
    enough, done = counted.filter("shared >= k").select("a", "b"), [counts, many]
    if not many.isEmpty():
        counted = stored(counted, "counted-pairs")
        often = many.groupBy("id").count()
        x, y = (often.select(F.col("id").alias(c), F.col("count").alias(f"often_{c}")) for c in "ab")
        weak = counted.filter("shared < k").join(x, "a").join(y, "b").filter(F.col("shared") + F.least("often_a", "often_b") >= F.col("k"))
        enough = counted.filter("shared >= k").select("a", "b").union(weak.select("a", "b"))
        done.append(counted)
    out = stored(enough, "open-pairs")
    for table in done:
        dropped(table)
    return out


def grouped(docs: DataFrame, set_words: int, radius: int, least: float, shard_items: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, item of all rows, and item, component, rep (doc_id, raw, times of the item's first row) of all items."""
    sets = stored(shingle_sets(docs, set_words, least), "sets")
    same = sets.groupBy("item", "doc_id", "raw").agg(F.min(F.struct("row", "fp", "n", "bits")).alias("x"), F.count("*").alias("times"))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw", "times")
    items = same.groupBy("item").agg(F.min("x").alias("x"), F.min(rep).alias("rep"))
    items = stored(items.select("item", "rep", F.col("x.row").alias("id"), "x.fp", "x.n", "x.bits"), "items")
    keyed = stored(sets.select("doc_id", "item"), "rows")
    tokens = shared_tokens(sets, items)
    dropped(sets)
    proposed = links(items.select("id", "fp"), items.count(), items, radius, shard_items).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = star_pairs(tokens, items, least)
    pairs = stored(possible(proposed.union(stars).distinct(), items, least), "proposed")
    found = similar(pairs, items, docs, set_words, least)
    now = stored(with_component(items, [found]), "components")
    pairs = open_pairs(tokens, now, least)
    dropped(tokens)
    more = similar(pairs, items, docs, set_words, least)
    if not more.isEmpty():
        before, now = now, stored(with_component(items, [found, more]), "components")
        dropped(before)
    return keyed, now.select("item", "component", "rep")


def near_duplicates(docs: DataFrame, set_words: int = 5, radius: int = 2, least: float = 0.8, shard_items: int = 8_192) -> DataFrame:
    """doc_id, component_id of every row of ``docs`` (doc_id, text): groups of texts whose shingle sets are ``least`` similar.

    component_id is the smallest doc_id of the group, NULL where no row of it has one. A text's words are those of op3;
    a text of fewer than ``set_words`` words is one shingle. NULL and blank texts are one item. Rows that share a
    doc_id but not a text are items of their own.
    """
    keyed, items = grouped(docs, set_words, radius, least, shard_items)
    smallest = items.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    of_item = items.join(smallest, "component").select("item", "component_id")
    return keyed.select("doc_id", "item").join(of_item, "item").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, set_words: int = 5, radius: int = 2, least: float = 0.8, shard_items: int = 8_192) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the smallest doc_id's (NULL last), then by digest of the text.

    Of rows equal in doc_id and text the first by their other columns (as JSON) stays.
    """
    keyed, items = grouped(docs, set_words, radius, least, shard_items)
    keep = stored(items.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.raw", "rep.times"), "kept")
    dropped(keyed)
    name, raw = free_name(docs, "_name"), free_name(docs, "_raw")
    rows = docs.withColumn(name, F.col("doc_id").cast("long")).withColumn(raw, raw_digest("text"))

    def among(wanted: DataFrame) -> DataFrame:
        return rows.join(wanted, rows[name].eqNullSafe(wanted["doc_id"]) & (rows[raw] == wanted["raw"]), "left_semi")

    out = among(keep.filter("times = 1")).select(*docs.columns)
    repeated = keep.filter("times > 1")
    if repeated.isEmpty():
        return out
    whole = F.struct(*docs.columns)
    first = among(repeated).groupBy(name, raw).agg(F.min_by(whole, F.to_json(whole)).alias(name + "_row")).select(F.col(name + "_row").alias("r")).select("r.*")
    return out.union(first.select(*docs.columns))
