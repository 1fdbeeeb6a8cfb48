"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The test items are read in blocks of a checked size, each block one broadcast; a larger benchmark means more passes,
never a larger broadcast. A first pass counts, over all documents, in how many each n-gram of the block occurs; seeds
are the n-grams of at most RARE documents (or RARE_SHARE of all) and the rarer half of each item's (ties kept). A part of
an item that leaked so often that none of its n-grams is rare is found by their number: an eighth of the item's n-grams
near each other count like a seed. The second pass aligns each passage around such hits with its item, word by word, by
Smith-Waterman with linear gaps. The score is the alignment's share of a perfect one: 1 for a verbatim copy, less with
every edited word. An alignment that reaches LEAST_SCORE has fewer gaps than its item has words, so a passage is taken
with as many words to either side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shared import stored

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, 1
LEAST_SCORE = 0.5
RARE, RARE_SHARE = 64, 0.001
#: The part of an item's n-grams that counts like a seed where none of them is one.
DENSE = 8
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: ASCII punctuation and white space part words; A-Z are lowered before, other characters stay.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(PARTS).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its raw score, and the passage position just after its end.

    A row per item word; gaps along the passage are a running maximum, so a row is a few vector operations.
    """
    steps = GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for word in item:
        now = np.maximum(row - GAP, 0)
        np.maximum(now[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=now[1:])
        row = np.maximum.accumulate(now + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Index:
    """The items of a block: their words as numbers, and where each seed stands in which item."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.vocabulary, self.items = [], {}, []
        short: dict[int, list[tuple[int, list[int]]]] = {}  # by words: items too short for a seed
        for item_id, text in items:
            words = words_of(text)
            if 0 < len(words) < SEED_WORDS:
                short.setdefault(len(words), []).append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
            elif words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64))
        self.base = len(self.vocabulary) + 1
        grams = [self.grams(x) for x in self.items]
        self.all = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        places = [np.arange(len(g)) for g in grams]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(np.concatenate(grams), kind="stable") if grams else np.zeros(0, np.int64)
        self.item_of, self.place_of = owner[order], (np.concatenate(places)[order] if grams else order)
        self.rare = np.zeros(len(order), dtype=bool)
        self.first = np.searchsorted(np.concatenate(grams)[order], self.all) if grams else order
        self.last = np.append(self.first[1:], len(order))
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self._grams, self._order = grams, order
        self.short: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for n, rows in short.items():
            of: dict[int, list[int]] = {}
            for item_id, words in rows:
                of.setdefault(int(self.grams(np.array(words, dtype=np.int64), n)[0]), []).append(item_id)
            self.short[n] = np.array(sorted(of), dtype=np.int64), of

    def grams(self, ids: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
        out = ids[: len(ids) - n + 1].copy()
        for k in range(1, n):
            out = out * self.base + ids[k : len(ids) - n + 1 + k]
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def found(self, ids: np.ndarray, among: np.ndarray, n: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Positions of n-grams of ``among`` in a text, and their index there."""
        if len(ids) < n or not len(among):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        whole = known[: len(ids) - n + 1].copy()
        for k in range(1, n):
            whole &= known[k : len(ids) - n + 1 + k]
        at = np.flatnonzero(whole)
        grams = ids[at]
        for k in range(1, n):
            grams = grams * self.base + ids[at + k]
        where = np.minimum(np.searchsorted(among, grams), len(among) - 1)
        hit = among[where] == grams
        return at[hit], where[hit]

    def choose_seeds(self, frequency: np.ndarray, n_docs: int) -> None:
        """frequency: documents, of ``n_docs``, that hold each n-gram of ``all``."""
        rare, least = [], max(RARE, RARE_SHARE * n_docs)
        for grams in self._grams:
            often = frequency[np.searchsorted(self.all, grams)]
            rare.append(often <= max(least, np.median(often)))
        if rare:
            self.rare = np.concatenate(rare)[self._order]

    def hits(self, text: str, kept: dict) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, word after the last) of every item that the text holds.

        kept: alignments of passages seen before by this task, so that copies are aligned once.
        """
        ids, out = self.numbers(words_of(text)), []
        for n, (grams, of) in self.short.items():
            at, which = self.found(ids, grams, n)
            which, first = np.unique(which, return_index=True)
            out += [(item_id, 1.0, int(at[k]), int(at[k]) + n) for g, k in zip(which, first, strict=True) for item_id in of[int(grams[g])]]
        at, gram = self.found(ids, self.all)
        if not len(at):
            return out
        count = self.last[gram] - self.first[gram]
        post = np.repeat(self.first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, shift, rare = self.item_of[post], np.repeat(at, count) - self.place_of[post], self.rare[post]
        order = np.lexsort((shift, item))
        item, shift, rare = item[order], shift[order], rare[order]
        size = self.sizes[item]
        place = item * (4 * (len(ids) + int(self.sizes.max()))) + shift  # items lie apart, whatever the shifts
        near = np.searchsorted(place, place + size, "right") - np.searchsorted(place, place - size, "left")
        good = rare | (near >= np.maximum(2, (size - SEED_WORDS + 1) // DENSE))
        item, shift = item[good], shift[good]
        for i in np.unique(item):
            words = self.items[i]
            size, shifts = len(words), shift[item == i]
            slack = size
            cut = np.flatnonzero(np.diff(shifts) > size + 2 * slack) + 1
            best = (0, 0, 0)
            for group in np.split(shifts, cut):  # windows that don't touch
                lo, hi = max(0, int(group[0]) - slack), min(len(ids), int(group[-1]) + size + slack)
                passage = ids[lo:hi]
                key = (int(i), passage.tobytes())
                if key not in kept:
                    if len(kept) > 20_000:
                        kept.clear()
                    score, end = align(words, passage)
                    start = end - align(words[::-1], passage[:end][::-1])[1] if 2 * score >= MATCH * size * LEAST_SCORE else 0
                    kept[key] = score, start, end
                score, start, end = kept[key]
                if score > best[0]:
                    best = score, lo + start, lo + end
            if best[0] >= LEAST_SCORE * MATCH * size:
                out.append((self.ids[i], best[0] / (MATCH * size), best[1], best[2]))
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast index with chosen seeds for each block of the benchmark; NULL items and texts hold no words."""
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index(sorted((r["item_id"], r["text"]) for r in part.collect()))  # a block, of a checked size
        plain = spark.sparkContext.broadcast(index)

        def count(batches: Iterable[pa.RecordBatch], plain=plain) -> Iterator[pa.RecordBatch]:
            index = plain.value
            total, docs = np.zeros(len(index.all), dtype=np.int64), 0
            for batch in batches:
                docs += batch.num_rows
                for text in batch.column(1):
                    if (t := text.as_py()) is not None:
                        total[np.unique(index.found(index.numbers(words_of(t)), index.all)[1])] += 1
            some = np.flatnonzero(total)
            # the number of documents under the number -1
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], docs))], names=["gram", "n"])

        often, n_docs = np.zeros(len(index.all), dtype=np.int64), 0
        for row in _texts(docs).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            if row["gram"] < 0:
                n_docs = row["n"]
            else:
                often[row["gram"]] = row["n"]  # at most the block's n-grams
        index.choose_seeds(often, n_docs)
        plain.destroy()
        yield spark.sparkContext.broadcast(index)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word for every document that holds a copy of a test item.

    A copy is a passage whose best alignment reaches LEAST_SCORE of a perfect one; of several in one document the
    best counts, of equally good ones the first. Items under SEED_WORDS words count where they stand whole. NULL and
    blank texts and items hold nothing. Repeated rows are reported each; repeated items under each of their ids. Empty
    tables give no rows.
    """
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, shared in enumerate(indexes(docs, benchmark)):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, kept = shared.value, {}
            for batch in batches:
                rows = [(doc_id.as_py(), *hit) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) if text.as_py() for hit in index.hits(text.as_py(), kept)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found = _texts(docs).mapInArrow(run, schema)
        out = out.union(found) if k else found
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no copy of a test item; rows are judged each by itself.

    Each block of items counts over what the blocks before it left, stored once.
    """
    at, schema = docs.columns.index("text"), docs.schema
    for k, shared in enumerate(indexes(docs, benchmark)):
        docs = stored(docs, "clean") if k else docs

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, kept = shared.value, {}
            for batch in batches:
                yield batch.filter(pa.array([not (t.as_py() and index.hits(t.as_py(), kept)) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
