"""URL filters from a sorted digest array.

Entries (a host and a path prefix) are hashed to 64-bit xxhash keys. Spark sorts them by key into range shards, and
each task packs its shard into one file of the shared folder::

    count int64 | keys int64[count], ascending | flags uint8[count] | ends int64[count] | strings

A worker memory-maps the files (a shared local path directly, any other store through a local copy), so the list
is on disk, not in the heap, and nothing of it goes through the driver. Each url offers the keys of its host
suffixes with the path prefixes of the lengths in the list; all keys of a batch are probed with one vectorised
binary search, and a hit counts only if the stored string is the same.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.shared import new_path

SEED = 42
RULE_ALLOW, RULE_BLOCK, LISTED = 1, 2, 4
#: Host labels that mark unwanted sites, as whole parts between hyphens.
UNWANTED = ("adult", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "warez", "xxx")
UNWANTED_HOST = r"(?:^|\.)((?:[^.]*-)?(?:" + "|".join(UNWANTED) + r")(?:-[^.]*)?\.[^/]*)$"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    start = (url or "").find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    end = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def host_column(url: str):
    """The host of split_url as a column."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unwanted_hosts(pages: DataFrame) -> DataFrame:
    """host, path of a block list from the pages themselves: sites whose host has an UNWANTED label, every path."""
    site = F.regexp_extract(host_column("url"), UNWANTED_HOST, 1)
    return pages.select(site.alias("host"), F.lit("").alias("path")).filter("host <> ''").distinct()


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), SEED)


def pack(keys: list[int], flags: list[int], strings: list[bytes]) -> bytes:
    return b"".join([np.array([len(keys)], "<i8").tobytes(), np.array(keys, "<i8").tobytes(), np.array(flags, "u1").tobytes(), np.cumsum([len(s) for s in strings], dtype="<i8").tobytes(), *strings])


class Shard:
    """A packed file, memory-mapped."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view("<i8")[0])
        self.keys, self.flags = data[8 : 8 + 8 * n].view("<i8"), data[8 + 8 * n : 8 + 9 * n]
        self.ends = np.frombuffer(data[8 + 9 * n : 8 + 17 * n], "<i8")
        self.strings = data[8 + 17 * n :]

    def flag(self, i: int, string: bytes) -> int:
        """The flags stored for ``string`` from entry i on; entries with an equal key are a collision."""
        key = self.keys[i]
        while i < len(self.keys) and self.keys[i] == key:
            start = int(self.ends[i - 1]) if i else 0
            if self.strings[start : int(self.ends[i])].tobytes() == string:
                return int(self.flags[i])
            i += 1
        return 0


class DigestArray:
    """All shards of a list, in key order."""

    def __init__(self, path: str, files: list[tuple[str, int]]):
        fs, root = pafs.FileSystem.from_uri(path)
        self.shards, self.firsts = [], np.array([first for _, first in files], dtype=np.int64)
        for file, _ in files:
            if isinstance(fs, pafs.LocalFileSystem):
                self.shards.append(Shard(np.memmap(f"{root}/{file}", dtype=np.uint8, mode="r")))
            else:
                with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(f"{root}/{file}") as source:
                    while part := source.read(1 << 22):
                        copy.write(part)
                    copy.flush()
                    self.shards.append(Shard(np.memmap(copy.name, dtype=np.uint8, mode="r")))  # the mapping outlives the name

    def flags(self, strings: list[bytes]) -> np.ndarray:
        """The stored flags of each string, 0 where it is not in the list."""
        out = np.zeros(len(strings), dtype=np.int64)
        keys = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], dtype=np.uint64).view(np.int64)
        of = np.searchsorted(self.firsts, keys, side="right") - 1
        for k in np.unique(of[of >= 0]):
            shard, mine = self.shards[k], np.flatnonzero(of == k)
            at = np.searchsorted(shard.keys, keys[mine])
            hit = (at < len(shard.keys)) & (shard.keys[np.minimum(at, len(shard.keys) - 1)] == keys[mine])
            for i, j in zip(mine[hit].tolist(), at[hit].tolist(), strict=True):
                out[i] = shard.flag(j, strings[i])
        return out


_open: dict[str, DigestArray] = {}


def opened(path: str, files: list[tuple[str, int]]) -> DigestArray:
    """One mapping per worker and list."""
    if path not in _open:
        _open.clear()
        _open[path] = DigestArray(path, files)
    return _open[path]


def build(entries: DataFrame, entries_per_shard: int = 1_000_000) -> tuple[str, list[tuple[str, int]], list[int], int]:
    """Write entries (host, path, flag) as a digest array: its path, (file, first key) of each shard, path lengths, and
    the most labels that a host of an entry has.

    Flags of equal strings are joined. What comes back to the driver is a row per shard and the distinct lengths.
    """
    spark = entries.sparkSession
    path = new_path(spark, "digests")
    named = entries.select(F.concat("host", "path").alias("string"), F.length("path").alias("length"), F.col("flag").cast("int").alias("flag"), F.size(F.split("host", "[.]", -1)).alias("labels"))
    merged = named.groupBy("string").agg(F.bit_or("flag").alias("flag"), F.collect_set("length").alias("lengths"))
    size = named.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths"), F.max("labels").alias("labels")).first()
    if not size["n"]:
        return path, [], [], 0

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, flags, strings = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            flags += batch.column(1).to_pylist()
            strings += batch.column(2).to_pylist()
        if keys:
            fs, root = pafs.FileSystem.from_uri(path)
            fs.create_dir(root, recursive=True)
            file, draft = f"{TaskContext.get().partitionId():08d}.digests", f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(pack(keys, flags, strings))
            fs.move(draft, f"{root}/{file}")
            yield pa.RecordBatch.from_pylist([{"file": file, "first": keys[0]}], schema=pa.schema([("file", pa.string()), ("first", pa.int64())]))

    rows = merged.select(F.xxhash64("string").alias("key"), "flag", F.col("string").cast("binary").alias("string"))
    ordered = rows.repartitionByRange(-(-size["n"] // entries_per_shard), "key").sortWithinPartitions("key", "string")
    files = sorted((r["first"], r["file"]) for r in ordered.mapInArrow(write, "file string, first long").collect())
    return path, [(file, first) for first, file in files], sorted(size["lengths"]), size["labels"]


def rule_entries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as entries."""
    return spark.createDataFrame([(host, path, RULE_ALLOW if verdict == "allow" else RULE_BLOCK) for verdict, host, path in rules], "host string, path string, flag int")


def suffixes(host: str, labels: int) -> Iterator[int]:
    """Where the suffixes of up to ``labels`` labels start, the shortest first; an empty host has none."""
    start = len(host) + 1
    while host and start and labels:
        start = host.rfind(".", 0, start - 1) + 1
        labels -= 1
        yield start


def judge(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages`` (page_id, url).

    entries: host, path, flag (RULE_ALLOW, RULE_BLOCK, LISTED). An entry fits its host and all subdomains where the
    url's path starts with the entry's. The longest fitting rule gives the verdict; without one, a listed url is
    blocked and any other allowed. NULL urls and urls without ``://`` have no host and are allowed. Repeated rows
    are judged each; an empty list allows everything. Only suffixes of a host with at most as many labels as the list's
    longest host are probed, so a url of any length costs memory in proportion to itself. Other columns are not read.
    """
    path, files, lengths, labels = build(entries)
    schema = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()), ("listed", T.BooleanType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = opened(path, files) if files else None
        for batch in batches:
            urls = [split_url(u.as_py()) for u in batch.column(1)]
            owner, strings = [], []
            for i, (host, tail) in enumerate(urls):
                for start in suffixes(host, labels):
                    for n in lengths:
                        if n <= len(tail):
                            owner.append(i)
                            strings.append((host[start:] + tail[:n]).encode("utf-8", "replace"))
            flags = array.flags(strings) if array and strings else np.zeros(len(strings), dtype=np.int64)
            rule: list[str | None] = [None] * len(urls)
            verdict, listed = ["allow"] * len(urls), [False] * len(urls)
            for k in np.flatnonzero(flags).tolist():
                i, flag, string = owner[k], int(flags[k]), strings[k].decode()
                listed[i] |= bool(flag & LISTED)
                if flag & (RULE_ALLOW | RULE_BLOCK) and (rule[i] is None or len(string) > len(rule[i])):
                    rule[i], verdict[i] = string, "block" if flag & RULE_BLOCK else "allow"
            verdict = [v if r is not None else "block" if x else "allow" for v, r, x in zip(verdict, rule, listed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(listed, pa.bool_())], names=schema.names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, schema)
