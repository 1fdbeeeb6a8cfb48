"""Sharding with equal bytes: multiway Karmarkar-Karp differencing over indivisible groups of equal texts.

Copies of a text must share a shard, so a group's summed size is one number to place. Differencing keeps a set of
partial partitions, each a vector of shard sums, takes the two of largest spread, lays the largest sum of one on the
smallest of the other, and repeats until one partition is left; walking the merges back gives every number its shard.

Differencing is sequential, so Spark brings it a bounded number of numbers whatever the input: a group above an
``items``-th of all bytes is a number of its own (there can be fewer than ``items``), all smaller groups are dealt by a
hash of their text into ``items`` packets of whole groups. The merges see at most 2 ``items`` numbers; all else is
aggregation and broadcast joins of tables of that size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtide.llm.shared import free_name, stored

ITEMS = 8192
#: Bytes that a document takes beside its text.
OVERHEAD = 16


def differenced(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each size, by largest differencing of ``shards``-way partial partitions.

    A partial partition is its ascending vector of sums less the smallest. Ties of spread go to the older partition, so
    the result depends on the order of ``sizes`` only.
    """
    n = len(sizes)
    sums: dict[int, np.ndarray] = {}
    for i, size in enumerate(sizes):
        sums[i] = np.zeros(shards, dtype=np.int64)
        sums[i][-1] = size
        sums[i] -= sums[i][0]
    heap = [(-int(v[-1]), i) for i, v in sums.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]  # the largest of one on the smallest of the other
        order = np.argsort(both, kind="stable")
        place = np.empty(shards, dtype=np.int64)
        place[order] = np.arange(shards)
        merges.append((a, b, place))
        made = both[order] - both[order[0]]
        sums[n + len(merges) - 1] = made
        heapq.heappush(heap, (-int(made[-1]), n + len(merges) - 1))
    shard = np.zeros(n, dtype=np.int64)
    of = {n + len(merges) - 1: np.arange(shards)}  # a position within a partial partition -> the shard it became
    for k in range(len(merges) - 1, -1, -1):
        a, b, place = merges[k]
        mine = of.pop(n + k)
        for child, positions in ((a, mine[place]), (b, mine[place[::-1]])):
            if child < n:
                shard[child] = positions[-1]
            else:
                of[child] = positions
    return shard


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none for NULL) and OVERHEAD."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def _key(text: Column) -> Column:
    """Names a group: copies share it; two texts that share it by chance share a shard, no more."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shard_plan(docs: DataFrame, shards: int, key: Column, size: Column, items: int = ITEMS) -> DataFrame:
    """alone, item, size, shard: of each large group by its key (alone) and of each packet of small groups.

    At most 2 ``items`` rows, stored. ``key`` is a 64-bit name of a row's group.
    """
    groups = docs.groupBy(key.alias("_key")).agg(F.sum(size).alias("_size"))
    groups = stored(groups, "shard-groups")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    alone = F.col("_size") * F.lit(items) > F.lit(total)
    item = F.when(alone, F.col("_key")).otherwise(F.pmod("_key", F.lit(items)))
    numbers = groups.groupBy(alone.alias("alone"), item.alias("item")).agg(F.sum("_size").alias("size"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("alone", "ascending"), ("item", "ascending")])
        shard = differenced(table.column("size").to_numpy(), shards)
        return table.append_column("shard", pa.array(shard, pa.int32()))

    # at most 2 * items rows, in one task: each merge needs the one before it
    made = numbers.groupBy().applyInArrow(place, "alone boolean, item long, size long, shard int")
    return stored(made, "shard-plan")


def with_shard(docs: DataFrame, plan: DataFrame, key: Column, name: str, items: int = ITEMS) -> DataFrame:
    """``docs`` with the shard of each row's group. Both joins are with the plan, of at most ``items`` rows each."""
    k, heavy, packet = (free_name(docs, n) for n in ("_key", "_heavy", "_packet"))
    rows = docs.withColumn(k, key)
    large = F.broadcast(plan.filter("alone").select(F.col("item").alias("_item"), F.col("shard").alias(heavy)))
    small = F.broadcast(plan.filter("not alone").select(F.col("item").alias("_item"), F.col("shard").alias(packet)))
    rows = rows.join(large, rows[k] == large["_item"], "left").drop("_item")
    rows = rows.join(small, F.pmod(rows[k], F.lit(items)) == small["_item"], "left").drop("_item")
    return rows.withColumn(name, F.coalesce(heavy, packet)).drop(k, heavy, packet)


def slots(rows: DataFrame, label: str = "sharded") -> DataFrame:
    """``rows`` (with ``shard``) and ``slot``: 0, 1, 2, … within each shard, without gaps.

    Rows are numbered within (shard, file) of the stored table and each file's first number is a running sum of counts,
    so a shard with a third of all rows, or a row repeated without end, is never numbered by one task.
    """
    kept = stored(rows, label)
    named = kept.select("*", F.xxhash64("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    within = Window.partitionBy("shard", "_file")
    counts = named.groupBy("shard", "_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    offsets = counts.select("shard", "_file", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = named.withColumn("_at", F.row_number().over(within.orderBy("_row")) - 1)
    joined = numbered.join(offsets, ["shard", "_file"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at")).alias("slot"))


def balanced(docs: DataFrame, shards: int = 40, items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text): shards of near equal bytes.

    A NULL text has no bytes and is a copy of the empty one; NULL and repeated ids are rows like any other, repeated
    rows get a slot each; an empty table gives no row; other columns are not read. Texts of any length count whole.
    Texts are read once: what moves is 28 bytes a row.
    """
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    slim = stored(docs.select("doc_id", text_size(text).alias("size"), crc.alias("text_crc32"), _key(text).alias("key")), "shard-sizes")
    plan = shard_plan(slim, shards, F.col("key"), F.col("size"), items)
    return slots(with_shard(slim, plan, F.col("key"), "shard", items).drop("key"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, items: int = ITEMS, files: int = 8) -> DataFrame:
    """Write ``docs`` whole, all columns, as Parquet below ``path``/shard=N, up to ``files`` files a shard; the plan.

    A text of any length stays in one row. ``docs`` must not have a column ``shard``.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column shard already")
    key = _key(F.col("text"))
    plan = shard_plan(docs.select("text"), shards, key, text_size(F.col("text")), items)
    rows = with_shard(docs, plan, key, "shard", items)
    salt = free_name(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(shards * files, "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
    return plan
