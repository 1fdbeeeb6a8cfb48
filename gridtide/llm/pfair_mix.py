"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in a pseudo-random order, are cut into blocks of ``block_chars`` characters. Weights are whole
slots of a period: a source with k of ``period`` slots gets its j-th block released at slot floor((j-1) period / k)
and due by slot ceil(j period / k). Earliest-deadline-first over the released blocks fills one period, which meets
every deadline, so at any slot a source is less than one block from its share; all later periods repeat it. The
period is a table of ten rows a source whatever the data's size, and a block's slot is its period's start plus its place.

A source that has run out leaves its slots empty, so the others keep their proportions and no document is dropped.
An epoch has as many slots as the corpus has blocks: what an over-represented source holds beyond its share of it
lies past the epoch's end (``in_epoch`` is false). Blocks are counted whole there, so a source far below a block may
lie past the end as well. Whether a document is surplus is another question, in characters: ``in_share`` is false only
for what starts beyond its source's share of all characters, so never in a source at or under its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.llm.shared import stored

NO_SOURCE = "(none)"
BLOCK_CHARS = 65_536
PERIOD = 1_000
ROWS_PER_BUCKET = 2_000


def order_key(doc_id: Column) -> Column:
    """A pseudo-random but repeatable order: the id's md5."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def tempered_weights(totals: DataFrame, power: float = 0.9) -> DataFrame:
    """source, weight: sizes to a power below one, which moves share from large sources to small ones."""
    return totals.select("source", F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def share_chars(totals: DataFrame, weights: DataFrame) -> DataFrame:
    """source, share: the characters of the corpus that the source's weight stands for; NULL (no bound) if it has no more.

    Rounded to a thousandth before rounding up, so that floating-point sums never make a full share one too small.
    """
    every = Window.partitionBy(F.lit(0))  # a row per source
    share = F.sum("chars").over(every) * (F.col("weight") / F.sum("weight").over(every))
    sized = totals.join(weights, "source").withColumn("share", F.ceil(F.round(share, 3)).cast("long"))
    return sized.select("source", F.when(F.col("chars") > F.col("share"), F.col("share")).alias("share"))


def slots_per_period(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, slots, period: whole slots by largest remainder, one at least; the period grows with many sources."""
    every = Window.partitionBy(F.lit(0))  # a row per source
    sized = weights.withColumn("n", F.count("*").over(every)).withColumn("period", F.greatest(F.lit(period), 10 * F.col("n")).cast("long"))
    share = (F.col("period") - F.col("n")) * F.col("weight") / F.sum("weight").over(every)
    floors = sized.withColumn("share", share).withColumn("least", 1 + F.floor("share"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.floor("share") - F.col("share"), 9), "source"))
    return floors.withColumn("rest", F.col("period") - F.sum("least").over(every)).select("source", (F.col("least") + (rank <= F.col("rest")).cast("long")).alias("slots"), "period")


def period_plan(slots: DataFrame) -> DataFrame:
    """source, slots, period, turn (1 to slots), slot, release, deadline of one period, by earliest deadline first.

    A turn is one number, deadline times the number of sources plus the source's place by name, so the smallest number
    of the released turns takes the slot. A fold over the slots holds these numbers in one array; an outer fold
    over stretches of slots gathers what the inner ones picked. The period has ten slots a source at least, so the
    fold is one task over a table that grows with the sources alone: under a minute for 10,000 of them.
    """
    by_name = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")).cast("long") - 1  # a row per source
    ranked = slots.withColumn("i", by_name).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    turns = ranked.selectExpr("source", "i", "n", "slots", "period", "explode(sequence(1L, slots)) AS turn")
    turns = turns.selectExpr("*", "(turn - 1) * period div slots AS release", "(turn * period + slots - 1) div slots AS deadline")
    turns = stored(turns.selectExpr("*", "deadline * n + i AS number"), "mix-turns")
    every = slots.groupBy().agg(F.max("period").alias("q")).filter("q is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("t"))
    at = turns.groupBy(F.col("release").alias("t")).agg(F.collect_list("number").alias("fresh"))
    one = every.join(at, "t", "left").groupBy().agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("fresh", F.expr("cast(array() as array<bigint>)")).alias("fresh")))).alias("s"))
    one = one.filter("size(s) > 0").selectExpr("transform(s, x -> x.fresh) AS s", "cast(ceil(sqrt(size(s))) as int) AS wide")
    step = "concat(state.open, s[t])"
    inner = f"""aggregate(sequence(k * wide, least((k + 1) * wide, size(s)) - 1), named_struct('open', outer.open, 'picks', cast(array() as array<bigint>)),
        (state, t) -> transform(array({step}), o -> named_struct('open', array_remove(o, array_min(o)), 'picks', concat(state.picks, array(array_min(o)))))[0])"""
    stretches = "sequence(0, (size(s) - 1) div wide)"
    folded = one.selectExpr(f"""aggregate({stretches}, named_struct('open', cast(array() as array<bigint>), 'picks', cast(array() as array<array<bigint>>)),
        (outer, k) -> transform(array({inner}), x -> named_struct('open', x.open, 'picks', concat(outer.picks, array(x.picks))))[0]).picks AS picks""")
    picked = folded.select(F.posexplode(F.flatten("picks")).alias("slot", "number"))
    return turns.join(picked, "number").selectExpr("source", "slots", "period", "turn", "cast(slot AS long) AS slot", "release", "deadline")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """doc_id, source, chars, block, slot, release, deadline, in_epoch, in_share for every row of ``docs`` (doc_id, text, source).

    ``weights`` (source, weight; a row per source) default to tempered sizes; sources without a weight get the
    smallest share. NULL source is a source of its own, NULL text has no characters, NULL doc_id sorts as empty text.
    Order by slot, block, the id's md5 and doc_id to read the mix. Rows that repeat an id follow each other. A block
    starts with each ``block_chars`` of running characters, so a document longer than that leaves slots empty; a
    source then deviates by that document's length. An empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    # Rows of one id and length are one row with a count until the end: a window never holds what repeats.
    same = slim.groupBy("source", "doc_id", "chars").agg(F.count("*").alias("rows"))
    same = stored(same.withColumn("key", order_key(F.col("doc_id"))), "mix")
    totals = stored(same.groupBy("source").agg(F.sum(F.col("chars") * F.col("rows")).alias("chars"), F.sum("rows").alias("docs")), "mix-totals")
    given = tempered_weights(totals) if weights is None else totals.select("source").join(weights, "source", "left").select("source", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    given = stored(given, "mix-weights")
    slots = stored(slots_per_period(given, period), "mix-slots")
    plan = stored(period_plan(slots).select("source", "turn", "slot", "release", "deadline"), "mix-plan")
    # A row per source: joins broadcast it where it is measured to be small, and split a hot source where not.
    per_source = totals.select("source", F.ceil(F.col("docs") / ROWS_PER_BUCKET).alias("buckets")).join(share_chars(totals, given), "source").join(slots, "source")
    per_source = stored(per_source, "mix-sources")

    # Running characters in two steps: inside (source, bucket), then over the buckets' sums. A hot source is many buckets.
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2**32)
    bucketed = same.join(per_source, "source").withColumn("bucket", place.cast("long")).withColumn("sum", F.col("chars") * F.col("rows"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("source", "bucket").agg(F.sum("sum").alias("all")).select("source", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "chars").rowsBetween(Window.unboundedPreceding, -1)
    running = bucketed.withColumn("run", F.coalesce(F.sum("sum").over(inside), F.lit(0))).join(offsets, ["source", "bucket"])
    each = running.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    each = each.withColumn("from", F.col("offset") + F.col("run") + F.col("copy") * F.col("chars"))
    blocks = each.withColumn("block", F.expr(f"`from` div {block_chars}")).withColumn("turn", F.expr("block % slots + 1")).withColumn("start", F.expr("block div slots * period"))

    epoch = totals.agg(F.sum(F.greatest(F.ceil(F.col("chars") / block_chars), F.lit(1)))).first()[0] or 0
    slotted = blocks.join(plan, ["source", "turn"])
    in_share = (F.col("from") < F.col("share")) | F.col("share").isNull()
    shifted = [(F.col("start") + F.col(c)).alias(c) for c in ("slot", "release", "deadline")]
    return slotted.select("doc_id", "source", "chars", "block", *shifted, (F.col("start") + F.col("slot") < F.lit(epoch)).alias("in_epoch"), in_share.alias("in_share"))


#: The same in DuckDB: a recursive table fills the period, plain windows replace the buckets.
ORACLE = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source, coalesce(length(text), 0)::BIGINT AS chars,
           md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(chars)::BIGINT AS chars, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT source, pow(greatest(chars, 1)::DOUBLE, 0.9) AS weight, count(*) OVER () AS n FROM totals),
sized AS (SELECT source, greatest({PERIOD}, 10 * n) AS q, (greatest({PERIOD}, 10 * n) - n) * weight / sum(weight) OVER () AS share FROM w),
floors AS (SELECT source, q, share, 1 + floor(share)::BIGINT AS least FROM sized),
ranked AS (SELECT source, q, least, q - sum(least) OVER () AS rest,
                  row_number() OVER (ORDER BY round(floor(share) - share, 9), source) AS rank FROM floors),
slots AS (SELECT source, (least + CASE WHEN rank <= rest THEN 1 ELSE 0 END)::BIGINT AS k, q::BIGINT AS q FROM ranked),
packed AS (SELECT list(source ORDER BY source) AS names, list(k ORDER BY source) AS ks, max(q) AS q FROM slots),
edf(t, turn, pick) AS (
    SELECT -1::BIGINT, list_transform(ks, lambda x: 0::BIGINT), NULL::BIGINT FROM packed
    UNION ALL
    SELECT e.t + 1, list_transform(e.turn, lambda n, i: n + CASE WHEN i = p.pick THEN 1 ELSE 0 END), p.pick
    FROM edf e, packed, LATERAL (
        SELECT arg_min(i, (((e.turn[i] + 1) * q + ks[i] - 1) // ks[i]) * 100000 + i) AS pick
        FROM (SELECT unnest(range(1, len(ks) + 1)) AS i) WHERE e.turn[i] < ks[i] AND (e.turn[i] * q) // ks[i] <= e.t + 1) p
    WHERE e.t + 1 < q),
plan AS (SELECT names[pick] AS source, ks[pick] AS k, q, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS turn
         FROM edf, packed WHERE t >= 0),
epoch AS (SELECT sum(greatest(ceil(chars / {BLOCK_CHARS}.0), 1))::BIGINT AS epoch FROM totals),
run AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY key, doc_id, chars
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {BLOCK_CHARS} AS block FROM d)
SELECT r.doc_id, r.source, r.chars, r.block, r.block // k * q + slot AS slot,
       r.block // k * q + ((turn - 1) * q) // k AS release, r.block // k * q + (turn * q + k - 1) // k AS deadline,
       r.block // k * q + slot < epoch AS in_epoch
FROM run r JOIN plan p ON p.source = r.source AND p.turn = r.block % k + 1, epoch
"""
