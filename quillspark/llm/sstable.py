"""Token ids in sorted-string-table shards.

Layout of a shard (integers little-endian unless said otherwise)::

    data blocks    entries in key order, each block compressed with zstd;
                   entry = varint shared, varint unshared, varint value length,
                   unshared key bytes, value bytes; the first entry of a block
                   shares nothing
    sparse index   per block: 9-byte first key, u64 offset, u32 length, u32 raw length
    Bloom filter   bit array, K positions per key
    footer         struct FOOTER, then MAGIC

A key is one byte (0 for a null id, else 1) and the id as big-endian u64 with
its sign bit flipped, so byte order is id order.  A value is the document's ids,
u16 where the vocabulary fits, else u32.  Shards are written by Spark's own
writer, whose line separator is MAGIC, and so land on any file system.
"""
from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_counted
from .tokens import encoder

MAGIC = "QSST0001"
FOOTER = struct.Struct("<QQQQQQBB9s9s")  # index at, count, bloom at, bloom bytes, documents, ids, id width, K, first, last key
INDEX = struct.Struct("<9sQII")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 8 << 20
#: Bytes of text that one range of ids holds, on average.
RANGE_BYTES = 64 << 20
BLOOM_BITS = 10
BLOOM_K = 7


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _positions(key: bytes, bits: int) -> list[int]:
    """Bloom positions by double hashing of the key."""
    x = int.from_bytes(key, "big") * 0x9E3779B97F4A7C15 & (2**64 - 1)
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    step = (x >> 32) | 1
    return [((x & 0xFFFFFFFF) + i * step) % bits for i in range(BLOOM_K)]


class ShardWriter:
    def __init__(self, width: int):
        self.width, self.codec = width, pa.Codec("zstd")
        self.blocks: list[bytes] = []
        self.index: list[tuple] = []
        self.keys: list[bytes] = []
        self.raw, self.last, self.at, self.n_ids = bytearray(), b"", 0, 0

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        shared = 0
        if self.raw:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.raw += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += n_ids
        if len(self.raw) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.raw:
            data = self.codec.compress(bytes(self.raw), asbytes=True)
            self.index.append((self.first, self.at, len(data), len(self.raw)))
            self.blocks.append(data)
            self.at += len(data)
            self.raw = bytearray()

    @property
    def size(self) -> int:
        return self.at + len(self.raw)

    def finish(self) -> bytes:
        self._close_block()
        bits = max(64, (len(self.keys) * BLOOM_BITS + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _positions(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(INDEX.pack(*row) for row in self.index)
        footer = FOOTER.pack(
            self.at, len(self.index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, BLOOM_K, self.keys[0], self.keys[-1]
        )
        return b"".join(self.blocks) + index + bytes(bloom) + footer


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        self.data, end = memoryview(data), len(data) - len(MAGIC)
        if bytes(self.data[end:]) != MAGIC.encode():
            raise ValueError("not a token shard")
        (self.index_at, n, self.bloom_at, self.bloom_len, self.n_docs, self.n_ids, self.width, self.k, self.first, self.last) = FOOTER.unpack(
            self.data[end - FOOTER.size : end]
        )
        self.index = [INDEX.unpack(self.data[self.index_at + i * INDEX.size : self.index_at + (i + 1) * INDEX.size]) for i in range(n)]
        self.codec = pa.Codec("zstd")

    def _entries(self, block: tuple):
        _, at, size, raw = block
        buf = self.codec.decompress(self.data[at : at + size], raw, asbytes=True)
        pos, key = 0, b""
        while pos < raw:
            shared, pos = _read_varint(buf, pos)
            own, pos = _read_varint(buf, pos)
            length, pos = _read_varint(buf, pos)
            key = key[:shared] + buf[pos : pos + own]
            pos += own
            yield key, buf[pos : pos + length]
            pos += length

    def __iter__(self):
        for block in self.index:
            yield from self._entries(block)

    def may_contain(self, key: bytes) -> bool:
        bloom = self.data[self.bloom_at : self.bloom_at + self.bloom_len]
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _positions(key, self.bloom_len * 8))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, binary search of the sparse index,
        then a scan of the blocks that can hold the key."""
        if not self.first <= key <= self.last or not self.may_contain(key):
            return []
        firsts = [row[0] for row in self.index]
        at = bisect_right(firsts, key) - 1
        while at > 0 and firsts[at] == key:
            at -= 1
        found = []
        for block in self.index[at:]:
            if block[0] > key:
                break
            found += [v for k, v in self._entries(block) if k == key]
        return found


def _shards(tokenizer: str, end_id: int):
    def run(batches):
        enc = encoder(tokenizer)
        width = 2 if enc.vocab_size <= 1 << 16 else 4
        shard = None
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids in enc.encode(batch.column(1)):
                ids = np.append(ids, end_id).astype("<u2" if width == 2 else "<u4")
                shard = shard or ShardWriter(width)
                shard.add(key_of(doc_ids[row]), ids.tobytes(), len(ids))
                if shard.size >= SHARD_BYTES:
                    yield pa.record_batch([pa.array([shard.finish()], pa.binary())], ["shard"])
                    shard = None
        if shard:
            yield pa.record_batch([pa.array([shard.finish()], pa.binary())], ["shard"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write shards
    in ascending id order below ``path``.

    Null ids come first, repeated ids become repeated entries, an empty table
    gives no shard.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // RANGE_BYTES))
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    blobs = rows.mapInArrow(_shards(tokenizer, end_id), "shard binary").select(F.col("shard").cast("string").alias("value"))
    blobs.write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def _footers(batches):
    for batch in batches:
        shards = [Shard(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([s.first for s in shards], pa.binary()), pa.array([s.last for s in shards], pa.binary()), pa.array([s.n_docs for s in shards], pa.int64()), pa.array([s.n_ids for s in shards], pa.int64())],
            ["path", "first", "last", "n_docs", "n_ids"],
        )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: path, first and last key, documents, ids, and
    ``start``, the number of ids in all shards before it."""
    ws = Workspace(spark, "manifest")
    shards = _files(spark, path).mapInArrow(_footers, "path string, first binary, last binary, n_docs long, n_ids long")
    # summed by ranges of shards first, so that no task sees all of them
    order = ["first", "last", "path"]
    rows = ws.keep(shards.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shards")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("n_ids").alias("n"))  # a row per range
    sums = sums.select("range", F.coalesce(F.sum("n").over(before.orderBy("range")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("range").orderBy(*order)), F.lit(0))
    rows = rows.withColumn("within", within).join(F.broadcast(sums), "range")
    return rows.select("path", "first", "last", "n_docs", "n_ids", (F.col("base") + F.col("within")).alias("start"))


def _documents(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard, at = Shard(content), 0
            ids, starts, values, held = [], [], [], 0

            def flush():
                return pa.record_batch(
                    [pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())],
                    ["path", "id", "local_start", "ids"],
                )

            for key, value in shard:
                wide = np.frombuffer(value, f"<u{shard.width}").astype("<u4").tobytes()
                ids.append(id_of(key))
                starts.append(at)
                values.append(wide)
                at += len(wide) // 4
                held += len(wide)
                if held > 8 << 20:
                    yield flush()
                    ids, starts, values, held = [], [], [], 0
            yield flush()


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of the shards: id, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian u32)."""
    docs = _files(spark, path).mapInArrow(_documents, "path string, id long, local_start long, ids binary")
    offsets = Workspace(spark, "offsets").keep(manifest(spark, path).select("path", "start"), "shards")
    return join_counted(docs, offsets, "path").select(
        F.col("id").alias(id_col),
        (F.col("start") + F.col("local_start")).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], id_col: str = "doc_id") -> DataFrame:
    """Point reads of a stated list of ids: ``(doc_id, ids)``."""
    keys = sorted({key_of(x) for x in doc_ids})

    def run(batches):
        for batch in batches:
            for content in batch.column(1).to_pylist():
                shard = Shard(content)
                got = [(id_of(k), np.frombuffer(v, f"<u{shard.width}").astype("<u4").tobytes()) for k in keys for v in shard.get(k)]
                yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["id", "ids"])

    return _files(spark, path).mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)
