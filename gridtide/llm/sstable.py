"""Token output as sorted-string-table shards.

A shard holds documents in ascending key order::

    block*  zstd( entry* )        entry = shared(varint) rest(varint) n_tokens(varint) rest-of-key ids
    index   zstd( (last key, offset, length, first entry)* )
    bloom   bits of all keys of the shard
    footer  fixed 72 bytes: offsets and lengths of index and bloom, counts, width of an id, magic

Keys are one byte (0: NULL id, 1: an id) and the id as big-endian with its sign bit flipped, so that the byte
order is the numeric order with NULL first. In a block each key keeps only what differs from the key before it;
the first key of a block is whole, so a lookup needs the index, one block and no other.

Spark range-partitions the documents by id; each task tokenizes and writes shards of a bounded size below the shared
folder (write to a name of the attempt, then rename: a repeated task replaces its shards by the same bytes). The
manifest has each shard's first and last id, so a lookup finds the shards by id and in them the blocks.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridtide.llm.shared import new_path

MAGIC = b"GTSST001"
FOOTER = struct.Struct("<QQQQQQQQ8s")
END_ID = 2
BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id & (2**64 - 1)) ^ (1 << 63)).to_bytes(8, "big")


def decode_key(key: bytes) -> int | None:
    if key == b"\0":
        return None
    value = int.from_bytes(key[1:], "big") ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _bloom_positions(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Collects entries in key order and gives the bytes of a shard."""

    def __init__(self, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.id_bytes, self.block_bytes = id_bytes, block_bytes
        self.blocks: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.first, self.last, self.offset, self.tokens = [], 0, 0, b"", 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = os.path.commonprefix([self.last, key]) if self.block else b""
        rest = key[len(shared) :]
        entry = _varint(len(shared)) + _varint(len(rest)) + _varint(len(ids) // self.id_bytes) + rest + ids
        self.block.append(entry)
        self.keys.append(key)
        self.last, self.size, self.tokens = key, self.size + len(entry), self.tokens + len(ids) // self.id_bytes
        if self.size >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.blocks.append(data)
            self.index.append((self.last, self.offset, len(data), self.first))
            self.offset, self.first = self.offset + len(data), len(self.keys)
            self.block, self.size = [], 0

    def finish(self) -> bytes:
        self._close_block()
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_bloom_positions(key, bits)] = True
        index = self.zip.compress(b"".join(_varint(len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index))
        packed = np.packbits(bloom, bitorder="little").tobytes()
        at = self.offset
        footer = FOOTER.pack(at, len(index), at + len(index), len(packed), bits, len(self.keys), self.tokens, self.id_bytes, MAGIC)
        return b"".join([*self.blocks, index, packed, footer])


class ShardReader:
    """Reads a shard, in order or one key through Bloom filter, index and block, by calls of ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        if size < FOOTER.size:
            raise ValueError("not a shard: it is shorter than a footer")
        index_at, index_len, bloom_at, bloom_len, self.bits, self.entries, self.tokens, self.id_bytes, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: its footer has another magic")
        self.read, self.unzip = read, zstandard.ZstdDecompressor()
        raw, at, self.index = self.unzip.decompress(read(index_at, index_len)), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQQ", raw, at + n)))
            at += n + 24
        self.last_keys = [x[0] for x in self.index]
        self.bloom = read(bloom_at, bloom_len)

    @classmethod
    def of(cls, data: bytes) -> ShardReader:
        """A reader of a whole shard in memory."""
        return cls(lambda at, n: data[at : at + n], len(data))

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, _ = self.index[i]
        raw, at, key = self.unzip.decompress(self.read(offset, length)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, dtype=f"<u{self.id_bytes}", count=n, offset=at)
            at += n * self.id_bytes

    def items(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield decode_key(key), ids

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_positions(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of all entries of an id (repeated ids: in the order written)."""
        key = encode_key(doc_id)
        found: list[np.ndarray] = []
        if self.may_contain(key):
            i = bisect.bisect_left(self.last_keys, key)
            while i < len(self.index):
                found += [ids for k, ids in self._block(i) if k == key]
                if self.last_keys[i] != key:
                    break
                i += 1
        return found


#: The one normaliser and pre-tokenizer whose texts may be encoded word by word.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class KnownIds:
    """Strings with the bytes of their ids, as Arrow arrays; ``encode`` gives those of strings not met before."""

    def __init__(self, encode: Callable[[pa.Array], pa.Array], keep: int):
        self.encode, self.keep = encode, keep
        self._forget()

    def _forget(self) -> None:
        self.strings = pa.array([""], pa.large_string())  # the empty one stands before leading white space
        self.ids = pa.array([b""], pa.large_binary())

    def joined(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text: those of its white-space-separated strings, each distinct one encoded once."""
        if not len(texts):
            return []
        if self.strings.nbytes > 32 * self.keep:
            self._forget()
        cut = pc.ascii_split_whitespace(texts)
        strings = cut.values.dictionary_encode()
        place = pc.index_in(strings.dictionary, self.strings).fill_null(-1).to_numpy().copy()
        new = strings.dictionary.filter(pa.array(place < 0))
        place[place < 0] = np.arange(len(self.strings), len(self.strings) + len(new))
        self.ids = pa.concat_arrays([self.ids, self.encode(new)])
        self.strings = pa.concat_arrays([self.strings, new])
        ids = self.ids.take(pa.array(place[strings.indices.to_numpy()]))
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in pairwise(at)]


class WordTokenizer:
    """Encodes whole texts with a tokenizers file.

    Where the file has the normaliser and pre-tokenizer of WORDWISE (case and white space fall away, no token spans two
    pieces of the pre-tokenizer), a text's ids are those of its pieces in order. Arrow lower-cases and cuts the texts of
    nothing but PLAIN characters as the pre-tokenizer would, each distinct piece is encoded once, many in a call, and a
    text's ids are taken from those. Other texts are cut at white space: their plain words go that way too, each of
    their other distinct words through the whole tokenizer. What is kept is bounded. Texts with other than ASCII white
    space, or special-token strings, and all texts of any other file are encoded whole.
    """

    #: ASCII but for the separators x1c to x1f, Latin letters, common punctuation: NFC keeps them, each lower-cases alone.
    PLAIN = r"\x00-\x1b -\x7f¡-©«-±´¶-¸»¿-įı-ɏ‐-‧€"
    OTHER = rf"[^{PLAIN}]|<\|"
    #: The pre-tokenizer's pieces of lower-cased PLAIN characters, but for letters, which are what stands between them.
    BETWEEN = r"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r 0-9a-zß-öø-ʯⱥⱦ]+"
    #: White space beyond ASCII, and characters that join with what stands before them or lower-case by context.
    WHOLE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u0300-\\u036f\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]|<\\|")
    #: Bytes of text cut at a time, and strings encoded in a call.
    SLICE, CALL = 2 << 20, 1000

    def __init__(self, path: str, keep: int = 200_000):
        """``keep``: strings to keep with their ids, at 32 bytes each."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        settings = json.loads(self.whole.to_str())
        self.wordwise = (settings["normalizer"], settings["pre_tokenizer"]) == WORDWISE and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")
        self.cut = Tokenizer(self.whole.model)  # for what is lower-cased and cut
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.code, self.keep = "H" if self.width == 2 else "I", keep
        self.pieces, self.words = KnownIds(self._pieces, keep), KnownIds(self._words, keep)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _full(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece of lower-cased text."""
        counts, data = [np.zeros(1, dtype=np.int64)], []
        for i in range(0, len(pieces), self.CALL):
            part = pieces.slice(i, self.CALL).to_pylist()
            found = self.cut.encode(" ".join(part), add_special_tokens=False)
            counts.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
            data.append(self._pack(found.ids))
        ends = np.concatenate(counts).cumsum() * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word."""

        def batch(others: pa.Array) -> Iterator[bytes]:
            for i in range(0, len(others), self.CALL):
                yield from (self._pack(x.ids) for x in self.whole.encode_batch_fast(others.slice(i, self.CALL).to_pylist(), add_special_tokens=False))

        return pa.array(self._plain_or(words, batch), pa.large_binary())

    def _plain_or(self, texts: pa.Array, encode: Callable[[pa.Array], Iterable[bytes]]) -> list[bytes]:
        """The ids of each text, by its pieces if it is plain, else from ``encode``."""
        plain = pc.invert(pc.match_substring_regex(texts, self.OTHER))
        pieces = iter(self.pieces.joined(pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), self.BETWEEN, r" \0 ")))
        others = iter(encode(texts.filter(pc.invert(plain))))
        return [next(pieces) if x else next(others) for x in plain.to_pylist()]

    def _wordwise(self, texts: pa.Array) -> Iterable[bytes]:
        """The ids of texts that are not plain."""
        whole = [bool(self.WHOLE.search(x)) for x in texts.to_pylist()]
        words = iter(self.words.joined(texts.filter(pc.invert(pa.array(whole, pa.bool_())))))
        return [self._full(x.as_py()) if w else next(words) for x, w in zip(texts, whole, strict=True)]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (NULL counts as empty), in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.SLICE
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]):
            some = texts.slice(a, b - a)
            yield from self._plain_or(some, self._wordwise) if self.wordwise else map(self._full, some.to_pylist())
            pa.default_memory_pool().release_unused()  # else a worker holds what a slice took

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


#: What the manifest has of a shard: its place in the order, its file, the ids of its first and last entry, and sizes.
MANIFEST = [("shard", pa.int64()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64())]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = 32 << 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text; other columns are ignored) as shards below ``path``.

    Returns a row per shard (MANIFEST). NULL text counts as empty (just the end id); NULL ids sort first; rows that
    repeat an id are all kept, in the order of their texts' hashes, and may lie in several shards. An empty table
    writes no shard. A task writes about ``shard_bytes`` of text and closes a shard at so many bytes of ids, so what
    it holds is a shard, a slice of texts and a document, however long texts are dealt.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n, _ in MANIFEST])
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(8, -(-total // shard_bytes))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, done = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end, writer, size, first = encoder._pack([end_id]), ShardWriter(encoder.width, block_bytes), 0, None
        fs, root = pafs.FileSystem.from_uri(path)

        def closed(last: int | None) -> pa.RecordBatch:
            number = part * 1_000_000 + done
            fs.create_dir(root, recursive=True)
            file, draft = f"shard-{number:014d}.sst", f"{root}/.draft-{number:014d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(writer.finish())
            fs.move(draft, f"{root}/{file}")
            return pa.RecordBatch.from_pylist([dict(zip([n for n, _ in MANIFEST], (number, file, first, last, len(writer.keys), writer.tokens), strict=True))], schema=pa.schema(MANIFEST))

        doc_id = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids += end
                if writer.keys and size + len(ids) > shard_bytes:
                    yield closed(last)
                    writer, size, done = ShardWriter(encoder.width, block_bytes), 0, done + 1
                first = first if writer.keys else doc_id
                writer.add(encode_key(doc_id), ids)
                last, size = doc_id, size + len(ids)
        if writer.keys:
            yield closed(doc_id)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = cut.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(write, schema)
    manifest = f"{path.rstrip('/')}-manifest"
    written.write.parquet(manifest)  # runs the job once; the shards' sizes are small rows from here on
    return spark.read.schema(schema).parquet(manifest)


def look_up(wanted: DataFrame, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, ids (array of token ids) of every stored document whose doc_id stands in ``wanted`` (doc_id, as rows).

    The manifest's ranges (a row per shard) name the shards that may hold an id; a task opens such a shard by its
    footer and reads Bloom filter, index and the blocks of the ids asked for, nothing else.
    """
    ranges = sorted((encode_key(r["first_id"]), encode_key(r["last_id"]), r["file"]) for r in manifest.select("first_id", "last_id", "file").collect())
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id in batch.column(0).to_pylist():
                key = encode_key(doc_id)
                rows += [(ranges[k][2], doc_id) for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.int64())], names=["file", "doc_id"])

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name, reader, source = None, None, None
        for batch in batches:
            found = []
            for file, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                    reader = ShardReader(lambda at, n, source=source: source.read_at(n, at), source.size())
                found += [(doc_id, ids.tolist()) for ids in reader.get(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        if source is not None:
            source.close()

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(place, "file string, doc_id long")
    return asked.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(get, "doc_id long, ids array<long>")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the shard files below ``path``."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                ids, starts, counts, sums, at = [], [], [], [], 0
                for doc_id, tokens in ShardReader.of(content.as_py()).items():
                    ids.append(doc_id)
                    starts.append(at)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(parse, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "file").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards and read them back (see write_shards and read_shards)."""
    path = path or new_path(docs.sparkSession, "sst")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, tokenizer_path, **options))
