"""Line dedup by content-defined chunks, in DataFrame operations only.

Every line is hashed, and a rolling hash over the last two line hashes decides where chunks end: it is even or odd, and
a document is cut twice, after its even and after its odd lines. The cuts depend on nearby lines alone, so a passage
that stands elsewhere, at any offset, is cut at the same places from its second line on; two cuts, because a line that
lies in no whole chunk of one mostly does in the other. A chunk of two lines or more whose text stands in the corpus
before (by doc_id, then position) is removed. Hashes only propose repeats: chunks are grouped by their text itself.

Every removed line has an equal line at an earlier place. A later place that overlaps the first of its passage (lines
that repeat at once) removes nothing.

The chunks miss short passages: the first line of one is cut by the foreign line before it. ``without_passages`` is the
exact form: every pair of neighbouring lines, and every line of over LONG_LINE words, is a key of its own, so all of a
repeated passage goes wherever it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shared import stored

CUTS = 2
BASE, MODULUS = 1_000_003, 2_147_483_647
MIN_LINES = 2
LONG_LINE = 50
NO_LINES = "cast(array() as array<string>)"


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, rid (the row's identity: half of the SHA-256 of id and text), text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "-").otherwise(":"), F.coalesce("text", F.lit("")))
    return base.select("doc_id", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("rid"), "text")


def with_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lines", F.coalesce(F.split("text", "\n", -1), F.expr(NO_LINES)))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, rid, cut, first (line), n (lines), text of every chunk of both cuts."""
    rows = with_lines(identified(docs)).drop("text")
    hashed = rows.withColumn("h", F.expr("transform(lines, l -> cast(conv(substring(md5(l), 1, 7), 16, 10) as long))"))
    rolled = hashed.withColumn("r", F.expr(f"transform(h, (x, i) -> (CASE WHEN i = 0 THEN 0L ELSE h[i - 1] END * {BASE} + x) % {MODULUS} % {CUTS})")).drop("h")
    # Outer: for a plain explode the optimizer infers a filter on the array and computes its nested lambdas in it anew.
    each = rolled.withColumn("cut", F.explode_outer(F.array(*[F.lit(c) for c in range(CUTS)])))
    ended = each.withColumn("ends", F.expr("CASE WHEN size(lines) > 0 THEN filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 OR r[i] = cut) ELSE cast(array() as array<int>) END")).drop("r")
    cut = F.expr("""
        transform(ends, (e, k) -> transform(array(CASE WHEN k = 0 THEN 0 ELSE ends[k - 1] + 1 END), s -> named_struct(
            'first', s, 'n', e - s + 1, 'text', array_join(slice(lines, s + 1, e - s + 1), '\n')))[0])""")
    return ended.select("doc_id", "rid", "cut", F.explode_outer(cut).alias("c")).select("doc_id", "rid", "cut", "c.*").filter("n is not null")


def repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """rid, first, n of every chunk of ``min_lines`` lines or more whose text stands earlier in the corpus.

    Only keys and places of all chunks are shuffled; texts are fetched again for the places whose key repeats. Merge
    hints keep the joins alike at every size: what they join grows with the corpus.
    """
    places = stored(chunks(docs).filter(F.col("n") >= min_lines).select("rid", "cut", "first", "n", F.xxhash64("text").alias("key")), "chunk-places")
    twice = places.groupBy("cut", "key").agg(F.count("*").alias("times")).filter("times > 1").select("cut", "key")
    asked = places.join(twice.hint("merge"), ["cut", "key"], "left_semi").groupBy("rid").agg(F.collect_set(F.struct("cut", "first", "n")).alias("asked"))
    rows = with_lines(identified(docs).join(asked.hint("merge"), "rid")).drop("text")
    each = rows.select("doc_id", "rid", "lines", F.explode("asked").alias("c"))
    place = F.struct("doc_id", "rid", F.col("c.first").alias("line"))
    found = stored(each.select("c.cut", "c.n", F.expr("array_join(slice(lines, c.first + 1, c.n), '\n')").alias("text"), place.alias("place")), "chunks")
    earliest = stored(found.groupBy("cut", "text").agg(F.min("place").alias("earliest")), "chunk-firsts")
    later = found.join(earliest.hint("merge"), ["cut", "text"]).filter("place <> earliest")
    return later.select("place.rid", F.col("place.line").alias("first"), "n").distinct()


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text (without the repeated chunks), n_lines, removed_chunks, removed_lines of every row.

    NULL doc_id sorts first. NULL text stays NULL. Rows equal in doc_id and text share one fate: their chunks repeat
    earlier rows, never each other. An empty line ends like any other; a text of one line has no multi-line chunk.
    """
    spans = F.collect_set(F.struct("first", "n")).alias("gone")
    removed = stored(repeated_chunks(docs, min_lines).groupBy("rid").agg(spans), "chunks-gone")
    # Lines are split after the join, so the shuffle carries the text alone.
    rows = with_lines(identified(docs).join(removed.hint("merge"), "rid", "left"))
    kept = F.expr("CASE WHEN gone IS NULL THEN lines ELSE filter(lines, (l, i) -> NOT exists(gone, g -> i >= g.first AND i < g.first + g.n)) END")
    out = rows.withColumn("kept", kept)
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    return out.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks"), (F.size("lines") - F.size("kept")).cast("long").alias("removed_lines"))


def passage_keys(docs: DataFrame) -> DataFrame:
    """doc_id, rid, line, n (2: this line and the next, 1: a long line), key of every pair of lines and long line.

    Keys are SHA-256 of the text, so equal keys are equal texts. A pair of lines of spaces only is no passage.
    """
    rows = with_lines(identified(docs)).drop("text")
    key = "unhex(sha2({}, 256))"
    pair = F.expr(f"""
        CASE WHEN size(lines) > 1 THEN transform(sequence(0, size(lines) - 2), i -> CASE WHEN trim(lines[i]) <> '' OR trim(lines[i + 1]) <> '' THEN
            named_struct('line', i, 'n', 2, 'key', {key.format("concat(lines[i], '\n', lines[i + 1])")}) END) END""")
    long = F.expr(f"""
        transform(lines, (l, i) -> CASE WHEN length(l) > 2 * {LONG_LINE} AND regexp_count(l, '[^ \\\\t\\\\r]+') > {LONG_LINE} THEN
            named_struct('line', i, 'n', 1, 'key', {key.format("l")}) END)""")
    # Outer, as in chunks.
    each = rows.select("doc_id", "rid", F.explode_outer(F.concat(F.coalesce(pair, F.expr("array()")), long)).alias("p"))
    return each.select("doc_id", "rid", "p.*").filter("key is not null")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """rid, line: every line of a passage (two lines or more, or one long line) that stands earlier in the corpus.

    A place that shares lines with the first place of its passage is no repeat of it.
    """
    keys = stored(passage_keys(docs).withColumn("place", F.struct("doc_id", "rid", "line")).select("place", "n", "key"), "passage-places")
    earliest = keys.groupBy("n", "key").agg(F.min("place").alias("earliest"), F.count("*").alias("times")).filter("times > 1").drop("times")
    apart = (F.col("place.rid") != F.col("earliest.rid")) | (F.col("place.line") >= F.col("earliest.line") + F.col("n"))
    later = keys.join(earliest.hint("merge"), ["n", "key"]).filter(apart)
    return later.select("place.rid", F.explode(F.expr("sequence(place.line, place.line + n - 1)")).alias("line")).distinct()


def without_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the repeated passages), n_lines, removed_passages (runs of removed lines), removed_lines.

    NULL doc_id, NULL text and rows that are equal in doc_id and text are treated as in ``deduplicated``. An empty table
    gives no row; the work on a text of any length grows with its lines.
    """
    gone = stored(repeated_lines(docs).groupBy("rid").agg(F.sort_array(F.collect_set("line")).alias("gone")), "passages-gone")
    rows = with_lines(identified(docs).join(gone.hint("merge"), "rid", "left"))
    kept = F.expr("CASE WHEN gone IS NULL THEN lines ELSE transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]) END")
    out = rows.withColumn("kept", kept)
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    runs = F.expr("size(filter(gone, (x, k) -> k = 0 OR gone[k - 1] < x - 1))")
    return out.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(runs).cast("long").alias("removed_passages"), (F.size("lines") - F.size("kept")).cast("long").alias("removed_lines"))


#: The same in DuckDB, chunk by chunk in relations; documents are equal by (doc_id, text).
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
b AS (SELECT *, ((coalesce(lag(h) OVER w, 0) * {BASE} + h) % {MODULUS}) % {CUTS} AS r FROM h WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
c AS (SELECT doc_id, text, line, i, cut, coalesce(sum((r = cut)::INT) OVER (PARTITION BY doc_id, text, cut ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM b, (SELECT unnest(range(0, {CUTS})) AS cut)),
chunk AS (SELECT doc_id, text, cut, pos, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS part, count(*) AS n FROM c GROUP BY doc_id, text, cut, pos HAVING count(*) >= {MIN_LINES}),
gone AS (SELECT DISTINCT doc_id, text, first, n FROM (SELECT *, row_number() OVER (PARTITION BY cut, part ORDER BY doc_id, first) AS k FROM chunk) WHERE k > 1),
lost AS (SELECT DISTINCT l.doc_id, l.text, l.i FROM l JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND l.i >= g.first AND l.i < g.first + g.n),
per AS (SELECT l.doc_id, l.text, count(*)::BIGINT AS n_lines, count(lost.i)::BIGINT AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (lost.i IS NULL), '') AS kept
        FROM l LEFT JOIN lost ON lost.doc_id = l.doc_id AND lost.text = l.text AND lost.i = l.i GROUP BY l.doc_id, l.text),
cg AS (SELECT doc_id, text, count(*)::BIGINT AS removed_chunks FROM gone GROUP BY doc_id, text)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_chunks, 0) AS removed_chunks, coalesce(removed_lines, 0) AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents x LEFT JOIN per ON x.doc_id IS NOT DISTINCT FROM per.doc_id AND x.text = per.text LEFT JOIN cg ON cg.doc_id = x.doc_id AND cg.text = x.text
"""

_PAIRS = f"""
SELECT doc_id, text, i, 2 AS n, sha256(line || chr(10) || next) AS key FROM nx WHERE next IS NOT NULL AND (trim(line, ' ') <> '' OR trim(next, ' ') <> '')
UNION ALL SELECT doc_id, text, i, 1, sha256(line) FROM nx WHERE length(line) > {2 * LONG_LINE} AND len(regexp_extract_all(line, '[^ \\t\\r]+')) > {LONG_LINE}"""
#: without_passages in DuckDB; documents are equal by (doc_id, text), NULL ids first.
PASSAGES_ORACLE = f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS row FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT row, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
nx AS (SELECT *, lead(line) OVER (PARTITION BY row ORDER BY i) AS next FROM l),
p AS (SELECT row, i, n, key FROM ({_PAIRS.replace("doc_id, text, i", "row, i")})),
f AS (SELECT n, key, min({{'row': row, 'i': i}}) AS first, count(*) AS times FROM p GROUP BY 1, 2),
gone AS (SELECT DISTINCT row, unnest(range(i, i + n)) AS i FROM p JOIN f USING (n, key) WHERE times > 1 AND (row <> first.row OR i >= first.i + n)),
marked AS (SELECT l.row, l.i, l.line, g.i IS NOT NULL AS lost, lag(g.i IS NOT NULL, 1, false) OVER (PARTITION BY l.row ORDER BY l.i) AS before FROM l LEFT JOIN gone g ON g.row = l.row AND g.i = l.i),
per AS (SELECT row, count(*)::BIGINT AS n_lines, count_if(lost)::BIGINT AS removed_lines, count_if(lost AND NOT before)::BIGINT AS removed_passages, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '') AS kept FROM marked GROUP BY row)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_passages, 0) AS removed_passages, coalesce(removed_lines, 0) AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents x LEFT JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text LEFT JOIN per ON per.row = d.row
"""
