"""Ranked lexical search over an inverted index in blocks of documents.

``build_index`` turns whole texts into postings (term -> documents and counts) per block. ``search`` scores a stated set
of items against every block with integer BM25 weights. Within a block the short lists of an item are summed term at a
time into accumulators (document -> partial score); these, sorted and with their maxima, are then one more bounded
iterator beside the long lists, which are traversed document at a time in windows: a window whose summed maxima stay
below the k-th best score so far is skipped, and within a window lists that cannot lift a document over that score
by themselves are only probed for the documents that the others propose.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.llm.shared import stored

BLOCK_DOCS, BLOCK_BYTES = 4096, 32 << 20
#: Items are taken in blocks of so many rows or characters.
QUERY_ROWS, QUERY_CHARS = 1024, 4 << 20
#: Longest list that is summed into the accumulators; documents in a window.
SHORT, WINDOW = 64, 256
#: ASCII letters and digits, A-Z lowered; other ASCII separates, all else belongs to terms.
TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: The row of a block that holds its documents' ids and lengths.
HEADER = ""


class Codes(dict):
    """Numbers things in the order of first sight."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def _postings(block: int, ids: list, texts: list) -> pa.RecordBatch:
    """A block: its header row and a row per term with ascending document numbers and their counts."""
    codes, n = Codes(), len(ids)
    each = []
    for text in texts:
        words = terms_of(text)
        each.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    lengths = np.array([len(x) for x in each], dtype=np.int32)
    key, tf = np.unique(np.concatenate(each) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(codes) + 1) * n)
    offsets = np.concatenate([[0, 0], starts[1:]]).astype(np.int32)
    docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key % n).astype(np.int32)))
    counts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], starts + n]).astype(np.int32)), pa.array(np.concatenate([lengths, tf]).astype(np.int32)))
    named = pa.array([HEADER.encode(), *codes], pa.binary()).cast(pa.string())
    holders = pa.array([ids, *[None] * len(codes)], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(named), block), pa.int64()), named, docs, counts, holders], ["block", "term", "docs", "tfs", "ids"])


INDEX_SCHEMA = "block long, term string, docs array<int>, tfs array<int>, ids array<long>"


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): block, term, docs, tfs, ids.

    A row per block and term: numbers of documents within the block and how often each holds the term. The row of the
    empty term has all ids and lengths of the block. NULL texts have no terms; rows of the same id are documents each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if len(ids) >= block_docs or size >= block_bytes:
                    yield _postings(block, ids, texts)
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield _postings(block, ids, texts)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA), "search-index")


class Postings:
    """A term's list within a block, with its contributions and their maxima per window."""

    def __init__(self, docs: np.ndarray, value: np.ndarray, edges: np.ndarray):
        self.docs, self.value, self.starts = docs, value, np.searchsorted(docs, edges)
        self.top = np.zeros(len(edges) - 1, dtype=np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            self.top[some] = np.maximum.reduceat(value, self.starts[some])

    def times(self, weight: int) -> "Postings":
        out = object.__new__(Postings)
        out.docs, out.value, out.starts, out.top = self.docs, self.value * weight, self.starts, self.top * weight
        return out


def accumulated(lists: list[Postings], edges: np.ndarray) -> Postings:
    """Term at a time: the lists' sums per document as one list."""
    docs, at = np.unique(np.concatenate([x.docs for x in lists]), return_inverse=True)
    total = np.zeros(len(docs), dtype=np.int64)
    np.add.at(total, at, np.concatenate([x.value for x in lists]))
    return Postings(docs, total, edges)


def best_of_block(lists: list[Postings], edges: np.ndarray, order: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best of a block with at least ``floor``; ``order`` ranks documents of equal score."""
    short = [x for x in lists if len(x.docs) <= SHORT]
    walk = [x for x in lists if len(x.docs) > SHORT] + ([accumulated(short, edges)] if short else [])
    found, scores, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), floor
    if not walk:
        return found, scores
    tops = np.array([x.top for x in walk])
    bound = tops.sum(axis=0)
    for w in range(len(edges) - 1):
        if bound[w] < least:
            continue
        ranked = np.argsort(tops[:, w], kind="stable")
        upto = np.cumsum(tops[ranked, w])
        first = int(np.searchsorted(upto, least))  # the lists before it reach less than ``least`` together
        partial = np.zeros(edges[w + 1] - edges[w], dtype=np.int64)
        for i in ranked[first:]:
            a, b = walk[i].starts[w : w + 2]
            partial[walk[i].docs[a:b] - edges[w]] += walk[i].value[a:b]
        for j in range(first - 1, -1, -1):
            near = np.flatnonzero((partial > 0) & (partial + upto[j] >= least))
            if not len(near):
                break
            x = walk[ranked[j]]
            a, b = x.starts[w : w + 2]
            if a < b:
                at = np.searchsorted(x.docs[a:b], near + edges[w])
                hit = x.docs[a:b][np.minimum(at, b - a - 1)] == near + edges[w]
                partial[near[hit]] += x.value[a:b][at[hit]]
        good = np.flatnonzero(partial >= least)
        if len(good):
            found, scores = np.concatenate([found, good + edges[w]]), np.concatenate([scores, partial[good]])
            if len(found) > k:
                keep = np.lexsort((order[found], -scores))[:k]
                found, scores = found[keep], scores[keep]
                least = max(least, int(scores.min()))
    return found, scores


def _items(items: DataFrame) -> Iterator[list[tuple[int, int | None, list[str]]]]:
    """Blocks of (number, item_id, terms) of the items, each of bounded size."""
    block, chars = [], 0
    for number, (item_id, text) in enumerate(items.select(F.col("item_id").cast("long"), "text").toLocalIterator()):
        block.append((number, item_id, [t.decode() for t in terms_of(text)]))
        chars += len(text or "")
        if len(block) >= QUERY_ROWS or chars >= QUERY_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _scored(index: DataFrame, block: list[tuple[int, int | None, list[str]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """number, item_id, doc_id, score: the k best of every index block for one block of items."""
    spark = index.sparkSession
    asked = sorted({t for _, _, terms in block for t in terms})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [HEADER, *asked]], "term string"))  # bounded by QUERY_CHARS
    chosen = index.join(wanted, "term", "left_semi")
    df = {r["term"]: r["df"] for r in chosen.filter(F.col("term") != HEADER).groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    queries = []
    for number, item_id, terms in block:
        weights: dict[str, int] = {}
        for t in terms:
            if t in df:
                weights[t] = weights.get(t, 0) + term_weight(n_docs, df[t])
        queries.append((number, item_id, {t: w for t, w in weights.items() if w > 0}))
    shared = spark.sparkContext.broadcast(queries)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = table.column("term").to_pylist()
        tfs = table.column("tfs")
        head = names.index(HEADER)
        ids = table.column("ids")[head].as_py()
        lengths = np.array(tfs[head].as_py(), dtype=np.int64)
        m = 75 + (25 * lengths * n_docs) // n_terms
        order = np.lexsort(([0 if i is None else i for i in ids], [i is None for i in ids])).argsort(kind="stable")
        edges = np.minimum(np.arange(0, len(ids) + WINDOW, WINDOW), len(ids))
        lists: dict[str, Postings] = {}
        for i, name in enumerate(names):
            if i != head:
                docs, tf = (table.column(c)[i].values.to_numpy().astype(np.int64) for c in ("docs", "tfs"))
                lists[name] = Postings(docs, (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]), edges)
        rows: list[tuple] = []
        for number, item_id, weights in shared.value:
            mine = [lists[t].times(w) for t, w in weights.items() if t in lists]
            found, scores = best_of_block(mine, edges, order, k)
            rows += [(number, item_id, ids[d], s) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("number", "item_id", "doc_id", "score"), columns, strict=True)})

    return chosen.groupBy("block").applyInArrow(lambda table: run(table), "number long, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by ascending id.

    items: item_id, text. Every item row is a query of its own, NULL and repeated ids too; a NULL or empty text, or one
    without a known term, finds nothing. NULL doc_ids come after all others of their score. An empty index or no items
    give no row. Statistics cover the whole index.
    """
    spark = index.sparkSession
    n = F.col("tfs")
    heads = index.filter(F.col("term") == HEADER)
    total: Row = heads.agg(F.sum(F.size(F.filter(n, lambda x: x > 0))).alias("docs"), F.sum(F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    found = spark.createDataFrame([], "number long, item_id long, doc_id long, score long")
    if total["terms"]:
        for block in _items(items):
            found = found.unionByName(_scored(index, block, total["docs"], total["terms"], k))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS reps FROM q GROUP BY 1, 2),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
o AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN p USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
