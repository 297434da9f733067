"""Operator 3: token ids as sorted-string-table shards.

A shard is one file: segments, each followed by one line feed (0x0A) that belongs to no segment, so Spark's own
text writer can write it to any store it knows and its commit protocol survives lost executors.

    data block *   index   Bloom filter   footer

* data block: entries in ascending key order, ``varint(shared) varint(rest) key-suffix varint(value length)
  value``; ``shared`` counts bytes shared with the key before (0 every ``RESTART`` entries). Then the restart
  offsets as <u4 and their number as <u4. All that as one zstd frame, then a crc32 of the frame as <u4.
* key: 8 bytes, big-endian document number with the sign bit flipped, so byte order is numeric order.
* value: one byte, 2 or 4, then n ids, each <u2 or <u4, whichever holds them; the last is the end id.
* index: for each block ``<QII`` (offset, length, entries) and its first and last key.
* Bloom filter: ``<II`` (hashes k, bits m), then the bits; positions by double hashing of xxh3-128 in 64 bits.
* footer (fixed ``FOOTER`` bytes): ``<QIQIQQQQ`` index offset and length, filter offset and length, entries,
  tokens, smallest key's number as stored, the shard's place among all shards; then 8 bytes of magic.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, small_batches, with_uid
from lorespark.llm.tokens import encoder, gathered, tokenizer_path

END_ID, RESTART, BLOCK_BYTES, MAGIC = 2, 16, 1 << 16, b"LSSST\x00\x00\x01"
_FOOT = struct.Struct("<QIQIQQQQ")
FOOTER = _FOOT.size + len(MAGIC)
#: Texts' bytes for each shard: a shard is read whole by one task, so this bounds a reader's memory.
SHARD_BYTES = 32 << 20


def pack_key(n: int) -> bytes:
    return struct.pack(">Q", (n + (1 << 63)) & (1 << 64) - 1)


def unpack_key(k: bytes) -> int:
    return struct.unpack(">Q", k)[0] - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not ids.size or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(value[1:], f"<u{value[0]}").astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        n |= (c & 127) << shift
        at += 1
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, k: int, m: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b, full = h & (1 << 64) - 1, h >> 64 | 1, (1 << 64) - 1
    return [(a + i * b & full) % m for i in range(k)]


class ShardWriter:
    """Turn (key, value) pairs in ascending key order into a shard's segments, one block in memory at a time."""

    def __init__(self, block_bytes: int = BLOCK_BYTES, place: int = 0) -> None:
        self.limit, self.place, self.at, self.index, self.keys, self.tokens = block_bytes, place, 0, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.buf, self.restarts, self.n, self.last, self.first = bytearray(), [], 0, b"", b""

    def _close(self) -> bytes:
        body = bytes(self.buf) + np.array(self.restarts, "<u4").tobytes() + struct.pack("<I", len(self.restarts))
        body = self.pack.compress(body)
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append(struct.pack("<QII", self.at, len(body), self.n) + self.first + self.last)
        self.at += len(body) + 1
        self._fresh()
        return body

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """Returns a finished block, if this pair closed one."""
        if self.n % RESTART == 0:
            shared = 0
            self.restarts.append(len(self.buf))
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.buf += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.first, self.last, self.n = self.first or key, key, self.n + 1
        self.keys.append(key)
        self.tokens += (len(value) - 1) // value[0] if value else 0
        return self._close() if len(self.buf) >= self.limit else None

    def end(self) -> Iterator[bytes]:
        if self.n:
            yield self._close()
        index, index_at = b"".join(self.index), self.at
        yield index
        k, m = 7, max(64, -(-10 * len(self.keys) // 8) * 8)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.keys)), ">u8").astype(np.uint64).reshape(-1, 2)
        bits = np.zeros(m, bool)
        for i in range(k):  # as _probes
            bits[(h[:, 1] + np.uint64(i) * (h[:, 0] | np.uint64(1))) % np.uint64(m)] = True
        bloom, bloom_at = struct.pack("<II", k, m) + np.packbits(bits, bitorder="little").tobytes(), index_at + len(index) + 1
        yield bloom
        yield _FOOT.pack(index_at, len(index), bloom_at, len(bloom), len(self.keys), self.tokens, struct.unpack(">Q", self.keys[0])[0] if self.keys else 0, self.place) + MAGIC


def write_shard(pairs: Iterable[tuple[bytes, bytes]], block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    w = ShardWriter(block_bytes)
    for key, value in pairs:
        if (block := w.add(key, value)) is not None:
            yield block
    yield from w.end()


class Shard:
    """Read a shard from its bytes: ``scan`` in key order, ``get`` by Bloom filter, index and restart search."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data).cast("B")
        if len(data) < FOOTER + 1 or bytes(self.data[-1 - len(MAGIC) : -1]) != MAGIC:
            raise ValueError("not a shard, or a torn one")
        ia, il, ba, bl, self.entries, self.tokens, _, self.place = _FOOT.unpack(self.data[-1 - FOOTER : -1 - len(MAGIC)])
        step = 16 + 16
        raw = bytes(self.data[ia : ia + il])
        self.blocks = [(*struct.unpack_from("<QII", raw, i), raw[i + 16 : i + 24], raw[i + 24 : i + 32]) for i in range(0, il, step)]
        self.firsts = [x[3] for x in self.blocks]
        self.k, self.m = struct.unpack_from("<II", self.data, ba)
        self.bits = self.data[ba + 8 : ba + bl]

    def _block(self, i: int) -> tuple[memoryview, np.ndarray, int]:
        at, size, _, _, _ = self.blocks[i]
        b = self.data[at : at + size]
        if zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        b = memoryview(zstandard.ZstdDecompressor().decompress(b[:-4]))
        n = struct.unpack("<I", b[-4:])[0]
        end = len(b) - 4 - 4 * n
        return b, np.frombuffer(b[end:-4], "<u4"), end

    @staticmethod
    def _walk(b: memoryview, at: int, end: int) -> Iterator[tuple[bytes, memoryview]]:
        key = b""
        while at < end:
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            key = key[:shared] + bytes(b[at : at + rest])
            size, at = _read_varint(b, at + rest)
            yield key, b[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, memoryview]]:
        for i in range(len(self.blocks)):
            b, _, end = self._block(i)
            yield from self._walk(b, 0, end)

    def maybe(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.k, self.m))

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of the first entry with this key, or None."""
        if not self.blocks or not self.maybe(key):
            return None
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key and self.blocks[i - 1][4] >= key:  # equal keys may begin in the block before
            i -= 1
        for j in range(i, len(self.blocks)):
            if self.firsts[j] > key:
                return None
            b, restarts, end = self._block(j)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                first = next(self._walk(b, int(restarts[mid]), end))[0]
                lo, hi = (mid, hi) if first < key else (lo, mid - 1)
            for k, v in self._walk(b, int(restarts[lo]), end):
                if k == key:
                    return unpack_ids(v)
                if k > key:
                    return None
        return None


def write_tokens(docs: DataFrame, out_dir: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text, append ``end_id`` and write shards in ascending id order below ``out_dir``.

    Documents are dealt by ranges of (id, hash of the text, input partition), so file order and key order agree and one id
    on many rows is dealt to many shards; each task holds one block, and a shard knows its place. A null or empty
    text is a document of the end id alone. Repeated ids stay repeated keys, ordered by the text's hash; if any id
    is null all are numbered first (``with_uid``), nulls before others.
    """
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("t"))
    write_numbered(with_uid(narrow, "id", "t", unique=False), out_dir, path, end_id, shard_bytes)


def write_numbered(docs: DataFrame, out_dir: str, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """``write_tokens`` of documents (uid, t) that have their number."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w, some = encoder(path), ShardWriter(place=TaskContext.get().partitionId()), False
        for b in gathered(batches, 1):
            done = []
            flat, starts = enc.encode(b.column(1))
            ends = starts[1:] + np.arange(1, b.num_rows + 1)  # with an end id for each
            ids, is_end = np.empty(flat.size + b.num_rows, "<u4"), np.zeros(flat.size + b.num_rows, bool)
            is_end[ends - 1] = True
            ids[is_end], ids[~is_end] = end_id, flat
            narrow = int(ids.max()) < 1 << 16 if ids.size else True
            raw, width = (ids.astype("<u2").tobytes(), 2) if narrow else (b"", 0)
            at = 0
            for n, e in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                some = True
                value = b"\x02" + raw[at * width : e * width] if narrow else pack_ids(ids[at:e])
                at = e
                if (block := w.add(pack_key(n), value)) is not None:
                    done.append(block)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["segment"])
            del b, flat, starts, ends, ids, is_end, raw, done  # before the next batch is read
        if some:
            for x in w.end():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["segment"])

    size = docs.agg(F.sum(F.octet_length(F.col("t").cast("binary")))).first()[0] or 0
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    keyed = docs.select("uid", F.col("t").cast("string").alias("t"), F.xxhash64("t").alias("_tag"), F.spark_partition_id().alias("_row"))
    dealt = keyed.repartitionByRange(n, "uid", "_tag", "_row").sortWithinPartitions("uid", "_tag")
    dealt.select("uid", "t").mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("compression", "none").text(out_dir)


def read_tokens(spark, out_dir: str) -> DataFrame:
    """(shard, uid, before, n_tokens, ids_crc32) of every entry below ``out_dir``, decoded from the shards by Spark's
    file reader; shard is its place among all, before counts the shard's ids before the entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                keys, sizes, sums = [], [], []
                shard = Shard(raw.as_buffer())
                for k, v in shard.scan():
                    keys.append(unpack_key(k))
                    ids = unpack_ids(v)
                    sizes.append(ids.size)
                    sums.append(zlib.crc32(ids.tobytes()))
                n = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, shard.place)), pa.array(keys, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())], names=["shard", "uid", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out_dir).where(F.col("length") > 0)
    return files.select("content").mapInArrow(run, "shard long, uid long, before long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", out_dir: str | None = None) -> DataFrame:
    """Write shards, read them back: (id_col, start, n_tokens, ids_crc32) for each document in ascending id order.

    ``start`` counts all ids before a document: those of its own shard, counted while reading, and those of the
    shards before, one number for each shard. An empty table writes no shard and gives an empty result. Equal
    rows give equal rows, each with its own start; null ids come first.
    """
    from pyspark.sql import Window as W

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = docs.schema[id_col].dataType
    numbered = with_uid(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("t")), "id", "t", unique=False)
    out_dir = out_dir or scratch.path("shards")
    write_numbered(numbered, out_dir, path)
    scratch.release()
    found = scratch.save(read_tokens(spark, out_dir), "entries")
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = scratch.save(shards.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead")), "shards")
    out = found.join(shards, "shard").select("uid", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    if getattr(numbered, "_uid_is_id", False):
        return out.select(F.col("uid").cast(kind).alias(id_col), "start", "n_tokens", "ids_crc32")
    return out.join(numbered.select("uid", "id").distinct(), "uid").select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
