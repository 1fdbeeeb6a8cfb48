"""Phrase collocations from sorted count streams.

Phrases of one to five words are counted level by level. A phrase can reach ``least`` occurrences only if both phrases
of one word less inside it do, so each scan of the texts counts only what the level before leaves possible; those that
remain are told by a bitmap of ``bits`` bits over hashes, whose false members cost work and never change a count. Levels
with many distinct phrases are first counted by hash alone (an upper bound of each count), and by their words after.

The counts then lie in streams: cut at each place, a phrase is an entry of the stream sorted by its first part (prefix
order) and of the stream sorted by its rest (suffix order). Both are merge-joined in step with the sorted counts, which
gives each cut its left and right counts; where a part's count equals the whole phrase's, the same entries say that the
part never stands without the extension.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.llm.ranked_search import Codes
from gridtide.llm.shared import stored

LEAST, LONGEST, TOP = 100, 5, 2000
BITS = 1 << 27
SALTS = 16
#: Text bytes that a task holds as words at once, and hashes that it sorts at once.
CHUNK, HASHES = 4 << 20, 1 << 22
#: What ends a piece, what is between words, and a byte that UTF-8 never has as the mark of an end.
ENDS, MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
TABLE = bytes(255 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "lang string, phrase string, h long, n long"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, texts with a mark at every end of a piece), cut at marks to about CHUNK bytes."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        by_lang.setdefault(lang, []).append((text.as_py() or "").encode())
    for lang, texts in by_lang.items():
        data, at = b"\n".join(texts).translate(TABLE), 0
        while at < len(data):
            end = data.find(MARK, at + CHUNK) if len(data) - at > CHUNK else -1
            end = len(data) if end < 0 else end
            yield lang, data[at:end]
            at = end


def _within(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Chunk:
    """The words of a chunk, and the hashes and places of its possible phrases."""

    def __init__(self, lang: str, data: bytes):
        self.words = data.replace(MARK, b" \xff ").split(b" ")
        self.words = [w for w in self.words if w]
        codes = Codes()
        self.code = np.fromiter(map(codes.__getitem__, self.words), np.int64, len(self.words))
        seed = xxhash.xxh64_intdigest(lang.encode())
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in codes], dtype=np.uint64)
        self.hash = own[self.code]
        self.solid = self.code != codes.get(MARK, -1)

    def phrases(self, length: int, bitmaps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of ``length`` words whose parts, as far as bitmaps are given, are possible."""
        h, ok = self.hash, self.solid
        for m in range(1, length + 1):
            if m > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[m - 1 :]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                ok = ok[:-1] & ok[1:]
            if m in bitmaps:
                place = np.flatnonzero(ok)
                ok = np.zeros(len(ok), dtype=bool)
                ok[place[_within(h[place], bitmaps[m])]] = True
        place = np.flatnonzero(ok)
        return place, h[place]

    def counted(self, length: int, place: np.ndarray, h: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        """phrase, hash, count by the words themselves: should two phrases share a hash, they are told apart."""
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        span = np.arange(length)
        same = (self.code[place[first][inverse][:, None] + span] == self.code[place[:, None] + span]).all(axis=1)
        if not same.all():
            _, first, n = np.unique(self.code[place[:, None] + span], axis=0, return_index=True, return_counts=True)
        for i, count in zip(first.tolist(), n.tolist(), strict=True):
            at = int(place[i])
            yield b" ".join(self.words[at : at + length]), int(h[i].astype(np.int64)), count


def _scan(texts: DataFrame, spelled: list[int], hashed: list[int], bitmaps: dict[int, np.ndarray], total: bool = False) -> DataFrame:
    """SCHEMA: counts of the possible phrases of the lengths ``spelled`` by their words and of ``hashed`` by hash alone.

    With ``total`` also a row per chunk with neither, the number of words.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)  # BITS / 8 bytes each

    def batch(lang: list, phrase: list, h: list | np.ndarray, n: list | np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "h", "n"])

    def sums(pending: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(pending), return_counts=True)
        return batch([None] * len(h), [None] * len(h), h.view(np.int64), n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for rows in batches:
            for lang, data in _chunks(rows):
                chunk = Chunk(lang, data)
                if total:
                    yield batch([lang], [None], [None], [int(chunk.solid.sum())])
                for length in spelled:
                    made = list(chunk.counted(length, *chunk.phrases(length, shared.value)))
                    if made:
                        phrase, h, n = (list(x) for x in zip(*made, strict=True))
                        yield batch([lang] * len(made), phrase, h, n)
                for length in hashed:
                    _, h = chunk.phrases(length, shared.value)
                    pending.append(h)
                    size += len(h)
                if size >= HASHES:
                    yield sums(pending)
                    pending, size = [], 0
        if size:
            yield sums(pending)

    return texts.mapInArrow(run, SCHEMA)


def _summed(scan: DataFrame, least: int, label: str) -> DataFrame:
    """The counts of at least ``least`` (and all numbers of words), stored."""
    counts = scan.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
    return stored(counts.filter((F.col("n") >= least) | (F.col("phrase").isNull() & F.col("h").isNull())), label)


def _bitmap(counts: DataFrame, bits: int) -> np.ndarray:
    """The hashes of ``counts`` as ``bits`` bits: Spark makes 4 KB pieces, at most bits / 8 bytes come here."""
    at = F.pmod("h", F.lit(bits))
    pieces = counts.groupBy(F.floor(at / 32768).alias("piece")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of every phrase of up to ``longest`` words with f >= ``least``, and (lang, n), all words.

    ``bits`` is a power of two of at least 32,768. The texts are scanned once for each length from one to ``longest``.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    now = _summed(_scan(texts, [1], [], {}, total=True), least, "phrases-1")
    totals = now.filter("phrase is null").select("lang", "n")
    parts = [now.filter("phrase is not null").withColumn("m", F.lit(1))]
    bitmaps = {1: _bitmap(parts[0], bits)}
    if longest > 1:  # pairs, by hash
        bitmaps[2] = _bitmap(_summed(_scan(texts, [], [2], {1: bitmaps[1]}), least, "phrases-h2").filter("h is not null"), bits)
    if longest > 2:  # pairs by words, triples by hash
        both = _summed(_scan(texts, [2], [3], {2: bitmaps[2]}), least, "phrases-2")
        parts.append(both.filter("phrase is not null").withColumn("m", F.lit(2)))
        bitmaps = {3: _bitmap(both.filter("phrase is null"), bits)}
    elif longest == 2:
        parts.append(_summed(_scan(texts, [2], [], {2: bitmaps[2]}), least, "phrases-2").withColumn("m", F.lit(2)))
    words = F.length("phrase") - F.length(F.replace(F.col("phrase"), F.lit(" "))) + 1
    for m in range(4, longest + 1):  # few remain: the first of these scans also spells the triples
        made = _summed(_scan(texts, [3, 4] if m == 4 else [m], [], bitmaps), least, f"phrases-{m}").withColumn("m", words)
        parts.append(made)
        bitmaps = {m: _bitmap(made.filter(F.col("m") == m), bits)}
    if longest == 3:
        parts.append(_summed(_scan(texts, [3], [], bitmaps), least, "phrases-3").withColumn("m", F.lit(3)))
    counts = parts[0]
    for more in parts[1:]:
        counts = counts.unionByName(more)
    return counts.select("lang", "phrase", "m", F.col("n").alias("f")), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to ``longest`` words of each lang.

    docs: text, lang. NULL texts are empty, a NULL lang is ``und``; rows count as often as they occur; an empty table
    gives no row; other columns are not read. A score's ties go to the larger count, then to the phrase of smaller
    bytes. Products are decimals of 38 digits, so scores are exact while a phrase's 1000 a n stays below that.
    """
    counts, totals = phrase_counts(docs, least, longest, bits)
    counts = stored(counts, "phrase-counts")
    whole = counts.filter("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    cut = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - m)")})
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    cut = stored(cut, "phrase-cuts")
    score = F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cut.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    covered = cut.filter("k = m - 1 and a >= l").select("lang", F.col("first").alias("phrase"))
    covered = covered.union(cut.filter("k = 1 and a >= r").select("lang", F.col("rest").alias("phrase")))
    kept = best.join(covered.hint("merge"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "n", "best.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # a lang's first are among the first of each of its parts
    some = kept.withColumn("_at", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m} AS m, {' || '.join(f'''w{i} || chr(32)''' if i < m else f'w{i}' for i in range(1, m + 1))} AS phrase FROM g WHERE w{m} IS NOT NULL" for m in range(1, LONGEST + 1)
)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row, lang, unnest(list_zip(range(len(ps)), ps)) AS p FROM (SELECT row, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
toks AS (SELECT row, lang, p[1] AS piece, regexp_extract_all(p[2], '[^\x20\x09]+') AS ws FROM pieces),
w AS (SELECT row, lang, piece, unnest(range(len(ws))) AS i, unnest(ws) AS w1 FROM toks),
g AS (SELECT lang, w1, {', '.join(f'lead(w1, {m - 1}) OVER o AS w{m}' for m in range(2, LONGEST + 1))} FROM w WINDOW o AS (PARTITION BY row, piece ORDER BY i)),
c AS (SELECT lang, m, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
cut AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM c WHERE m > 1),
lr AS (SELECT x.*, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
       FROM cut x JOIN t USING (lang) JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(ws[:k], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM lr),
wide AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM c WHERE m > 2),
inner_parts AS (SELECT lang, f, ws, unnest(range(1, m + 1)) AS i, m FROM wide),
subs AS (SELECT lang, f, array_to_string(ws[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM inner_parts) WHERE j - i + 1 < m),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM subs s JOIN c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100 * s.f >= 100 * c.f),
rk AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
       FROM best b LEFT JOIN gone ON gone.lang = b.lang AND gone.phrase = b.phrase WHERE j = 1 AND gone.phrase IS NULL)
SELECT * FROM rk WHERE rank <= {TOP}
"""
