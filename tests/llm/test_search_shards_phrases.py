"""Operators 11 to 13 against brute-force versions, and their edge cases."""

import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import kk_shards, phrase_streams, ranked_search
from tests.conftest import DATA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "Lorem ipsum dolor " * 8000 + "9" * 20000 + "." * 3000
EDGES = [(1, None), (2, ""), (3, "   \n\n "), (4, LONG), (5, "same text here"), (5, "same text here"), (6, "same text here"), (None, "same Text"), (7, "ä" * 50 + " \U0001f600 x")]
SCHEMA = "doc_id long, text string, lang string, shard int, slot int, score string, term string, block long, key long, size string, f int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None, 9, 9, "x", "y", 1, 1, "z", 1) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 Ranked search


def brute_search(docs, items, k=20):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    counts, df = [Counter(t) for t in terms], Counter(w for t in terms for w in set(t))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), words, tf in zip(docs, terms, counts, strict=True):
            m = 75 + 25 * len(words) * n_docs // n_terms if n_terms else 0
            score = 0
            for t in TERM.findall(lower(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **blocks):
    out = ranked_search.search(ranked_search.build_index(docs, **blocks), items)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("block_docs", [7, 4096])
def test_search_equals_brute_force(spark, block_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "naïve", "x'y", "a_b", "Ω9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(40) if i % 9 else None, rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 30, 90])))) for i in range(150)] + [(3, None), (4, "")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for i in range(12)] + [(12, None), (13, "unknown"), (None, "W1 w1 w1 É")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, spark.createDataFrame(items, "item_id long, text string"), block_docs=block_docs) == brute_search(docs, items)


def test_search_edges(spark, edges, empty):
    items = [(1, "SAME x"), (1, "lorem"), (2, "")]
    queries = spark.createDataFrame([(i, t, 1, "n") for i, t in items], "item_id long, text string, rank int, doc_id string")
    assert found(edges, queries) == brute_search(EDGES, items)
    assert found(empty, queries) == [] and found(edges, queries.limit(0)) == []


def test_block_search_equals_full_sums():
    """Short and long lists, many windows, ties on the last place, and a floor."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        n = int(rng.integers(1, 2000))
        edges, order = np.minimum(np.arange(0, n + ranked_search.WINDOW, ranked_search.WINDOW), n), rng.permutation(n)
        lists, total = [], np.zeros(n, dtype=np.int64)
        for _ in range(int(rng.integers(0, 12))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.001, 0.02, 0.3, 0.9]))
            value = rng.integers(1, rng.choice([3, 1000]), len(docs))
            if len(docs):
                lists.append(ranked_search.Postings(docs, value, edges))
                total[docs] += value
        floor = int(rng.choice([1, 50]))
        docs, scores = ranked_search.best_of_block(lists, edges, order, 20, floor)
        keep = np.argsort(order[docs])[np.argsort(-scores[np.argsort(order[docs])], kind="stable")][:20]
        want = [d for d in np.lexsort((order, -total)) if total[d] >= floor][:20]
        assert docs[keep].tolist() == want and scores[keep].tolist() == total[want].tolist()


def test_index_keeps_every_term(spark, edges):
    index = ranked_search.build_index(edges, block_docs=2)
    assert index.filter("term = ''").select(F.sum(F.size("ids"))).first()[0] == len(EDGES)
    words = Counter(t for _, text in EDGES for t in set(TERM.findall(lower(text))))
    assert {r["term"]: r["n"] for r in index.filter("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("n")).collect()} == words


# 12 Sharding


def plain_differencing(sizes, shards):
    """The sums that largest differencing ends with, on lists."""
    heap = [(-s, i, [0] * (shards - 1) + [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        both = [x - both[0] for x in both]
        heapq.heappush(heap, (-both[-1], number, both))
        number += 1
    return heap[0][2]


@pytest.mark.parametrize("shards, n", [(2, 30), (3, 2), (5, 200), (40, 1000)])
def test_differencing_equals_the_plain_form(shards, n):
    rng = np.random.default_rng(shards)
    sizes = np.sort(rng.integers(1, 10**6, n))[::-1]
    shard = kk_shards.differenced(sizes, shards)
    sums = np.bincount(shard, sizes, shards).astype(int)
    assert sorted(sums - sums.min()) == plain_differencing(sizes.tolist(), shards)
    greedy = [0] * shards
    for s in sizes.tolist():
        greedy[greedy.index(min(greedy))] += s
    assert sums.max() - sums.min() <= max(greedy) - min(greedy)
    assert len(kk_shards.differenced(sizes[:0], shards)) == 0


def checked(docs, rows, shards):
    texts = Counter((i, t or "") for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sum((Counter({(i, len(t.encode()) + 16, zlib.crc32(t.encode())): n}) for (i, t), n in texts.items()), Counter())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= k < shards and sorted(v) == list(range(len(v))) for k, v in slots.items())
    return Counter({k: sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)})


def test_shards_of_given_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = kk_shards.balanced(docs, 8).collect()
    text_of = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sums = checked([(i, t) for i, t in text_of.items()], rows, 8)
    by_text = {}
    for r in rows:
        by_text.setdefault(text_of[r["doc_id"]], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by_text.values())
    assert max(sums.values()) - min(sums.values()) <= 64  # of some 350 kB each


@pytest.mark.parametrize("items", [16, 8192])
def test_hot_groups_stay_whole(spark, items):
    rng = random.Random(4)
    docs = [(i, "copied text " * 5) for i in range(300)] + [(i, "x" * rng.randrange(1, 2000)) for i in range(300, 900)] + [(7, "again")] * 40
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = kk_shards.balanced(frame, 10, items).collect()
    sums = checked(docs, rows, 10)
    assert len({r["shard"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and r["size"] == 76}) == 1
    assert max(sums.values()) - min(sums.values()) <= (60 if items > 1000 else max(sums.values()))


def test_sharding_edges(spark, edges, empty, tmp_path):
    checked(EDGES, kk_shards.balanced(edges, 3).collect(), 3)
    assert kk_shards.balanced(empty, 3).count() == 0
    whole = edges.drop("shard")
    path = f"file://{tmp_path}/out"
    kk_shards.write_shards(whole, path, 3)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert back.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError, match="column shard"):
        kk_shards.write_shards(edges, path, 3)


# 13 Phrases


def brute_phrases(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    often = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        inside = {q for (other, q), b in often.items() if other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))}
        if not inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    ranked = []
    for lang in totals:
        mine = sorted(x for x in out if x[0] == lang)[:top]
        ranked += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (_, s, a, p, l, r, n) in enumerate(mine, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("least, longest, top", [(2, 5, 2000), (3, 4, 7), (4, 3, 50), (3, 2, 50)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    rng = random.Random(least)
    words = ["a", "A", "be", "Ça", "d", "E", " x", "fin", "ça", "𝄞", "b#"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", "  ", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(rng.randrange(60))), rng.choice(["x", "y", None, "und"])) for _ in range(60)]
    rows += [("a a a a a a", "x")] * 3 + [("one two three four five six seven", "y")] * 5 + [(None, "x"), ("", None)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = phrase_streams.collocations(frame, least, longest, top, 1 << 15)  # a small bitmap: many false members
    want = brute_phrases(rows, least, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_chunks_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrase_streams, "CHUNK", 20)
    texts = ["one two three four five. six seven", "eight, nine ten", None, "eleven" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 4), pa.array(texts)], ["lang", "text"])
    parts = [data for _, data in phrase_streams._chunks(batch)]
    assert len(parts) > 2 and b"".join(parts) == "\n".join(t or "" for t in texts).encode().translate(phrase_streams.TABLE)
    chunk = phrase_streams.Chunk("x", b"a b a b\xffa b")
    assert sorted(chunk.counted(2, *chunk.phrases(2, {}))) == sorted(chunk.counted(2, *chunk.phrases(2, {})))
    assert {p: n for p, _, n in chunk.counted(2, *chunk.phrases(2, {}))} == {b"a b": 3, b"b a": 1}
    place, h = chunk.phrases(2, {})
    assert {p: n for p, _, n in chunk.counted(2, place, h * np.uint64(0))} == {b"a b": 3, b"b a": 1}  # all hashes equal


def test_collocation_edges(spark, edges, empty):
    got = phrase_streams.collocations(edges, 2, 5, 10, 1 << 15)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(t, None) for _, t in EDGES], 2, 5, 10)
    assert phrase_streams.collocations(empty, 2, 5, 10, 1 << 15).count() == 0
