"""Token-id shards with a minimal perfect hash index.

A shard file holds one block: raw ids (little-endian, 16 or 32 bits, each document followed by the end id), the index, a footer
and the mark ``MPH1``. The index maps a document key to its place without storing keys in the hash itself: levels of bit arrays
(a key sits in the first level where no other key falls on its bit; the rank of the bit is its slot), then per slot a 32-bit
fingerprint that rejects foreign keys and the document's ordinal. Spark's own text writer stores the blocks, with the mark as line
separator, so shards can be on any file system that Spark writes to, and a failed task leaves no half of a shard.

Documents are in ascending order of their keys: within a block, over the blocks of a partition, and over partitions, which are
ranges of keys. A block is closed at ``block_bytes``; a longer document has a block of its own.

Defined results: a null text is the empty text and has the end id alone; null keys come first and are reached by position, not
by key; rows that repeat a key are in the order of their ids and share a slot; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, materialise, scratch_path, table, tokenizer_path, unit_ids, whole_text

MARK = b"MPH1"
#: part, number in the part, bytes an id, documents, null keys, distinct keys, levels, bytes of payload
FOOTER = struct.Struct("<qqiqqqiq")
DENSITY = 1.5


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 .. n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, values: np.ndarray):
        self.levels, self.prints, self.values = levels, prints, values
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(np.r_[0, np.cumsum(bits)].astype(np.int64) + before)
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left):
            size = max(64, int(len(left) * DENSITY))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        out = cls(levels, np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8"))
        slots = out.slots(keys)
        out.prints[slots], out.values[slots] = out.fingerprint(keys), values
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, 1000) >> np.uint64(32)).astype("<u4")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slots[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return slots

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The stored value of each key, -1 for keys whose fingerprint differs."""
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slots = self.slots(keys)
        there = (slots >= 0) & (self.prints[slots] == self.fingerprint(keys))
        return np.where(there, self.values[slots], -1)

    def pack(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], "<i8").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.prints.tobytes() + self.values.tobytes()

    @classmethod
    def unpack(cls, data: memoryview, levels: int, keys: int) -> tuple[PerfectHash, int]:
        at, bits = 8 * levels, []
        for n in np.frombuffer(data[:at], "<i8"):
            size = -(-int(n) // 8)
            bits.append(np.unpackbits(np.frombuffer(data[at : at + size], np.uint8), count=int(n)).astype(bool))
            at += size
        prints = np.frombuffer(data[at : at + 4 * keys], "<u4")
        values = np.frombuffer(data[at + 4 * keys : at + 12 * keys], "<i8")
        return cls(bits, prints, values), at + 12 * keys


def pack_block(part: int, number: int, width: int, keys: list[int | None], payloads: list[bytes]) -> bytes:
    """A block without its mark. ``keys`` ascend, nulls first; payloads are ids with their end id."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], dtype=np.int64)
    distinct, first = np.unique(known, return_index=True)
    index = PerfectHash.build(distinct, first + nulls)
    offsets = np.r_[0, np.cumsum([len(p) for p in payloads], dtype=np.int64)].astype("<i8")
    payload = b"".join(payloads)
    tail = FOOTER.pack(part, number, width, len(keys), nulls, len(distinct), len(index.levels), len(payload))
    return b"".join((payload, offsets.tobytes(), known.astype("<i8").tobytes(), index.pack(), tail))


class Block:
    """A shard read back: ``ids(i)`` by position, ``find(key)`` in constant time by key."""

    def __init__(self, data: bytes):
        if data[-len(MARK) :] != MARK:
            raise ValueError("not a token shard, or a cut one")
        view, end = memoryview(data), len(data) - len(MARK) - FOOTER.size
        self.part, self.number, self.width, self.documents, self.nulls, distinct, levels, size = FOOTER.unpack(view[end : end + FOOTER.size])
        self.payload = view[:size]
        at = size + 8 * (self.documents + 1)
        self.offsets = np.frombuffer(view[size:at], "<i8")
        self.keys = np.frombuffer(view[at : at + 8 * (self.documents - self.nulls)], "<i8")
        at += 8 * (self.documents - self.nulls)
        self.index, used = PerfectHash.unpack(view[at:end], levels, distinct)
        if at + used != end:
            raise ValueError("the shard's parts do not fill it")

    def ids(self, position: int) -> np.ndarray:
        return np.frombuffer(self.payload[self.offsets[position] : self.offsets[position + 1]], f"<u{self.width}")

    def positions(self, keys: np.ndarray) -> np.ndarray:
        return self.index.get(np.ascontiguousarray(keys, dtype=np.int64))

    def find(self, key: int) -> np.ndarray | None:
        at = int(self.positions(np.array([key]))[0])
        return None if at < 0 else self.ids(at)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text",
    docs_per_part: int = 10_000, block_bytes: int = 12 << 20,
) -> None:
    """Encode every text and write shards to the folder ``path``. ``width``: 2 for vocabularies under 65,536 ids, else 4."""
    spark = docs.sparkSession
    bounded_batches(spark)
    end = end_id.to_bytes(width, "little")

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = unit_ids(tokenizer, width)
        made = [units.encode(x) + end for x in batch.column(1).to_pylist()]
        keys = batch.column(0)
        # How many cuts are at most the key, looked up in an array: a plan's size does not depend on the number of ranges. Null keys are in range 0.
        part = np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        part[keys.is_null().to_numpy(zero_copy_only=False)] = 0
        return pa.record_batch([keys, pa.array(made, pa.binary()), pa.array(part, pa.int64())], names=["key", "ids", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, payloads, size, number, part = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pack_block(part, number, width, keys, payloads)], pa.binary())], names=["block"])

        for batch in batches:
            for part_, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = part_
                if keys and size + len(ids) > block_bytes:
                    yield block()
                    keys, payloads, size, number = [], [], 0, number + 1
                keys.append(key)
                payloads.append(ids)
                size += len(ids)
        if keys:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), whole_text(text_col).alias("text"))
    ids_only = rows.select("key").where("key is not null")
    parts = max(1, -(-ids_only.count() // docs_per_part))
    found = ids_only.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    cuts = np.array(sorted({int(c) for c in found}), dtype=np.int64)
    encoded = map_batches(rows, encode, "key long, ids binary, part long")
    shards = (
        encoded.repartitionById(len(cuts) + 1, F.col("part").cast("int"))
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
        .select("part", "key", "ids")
        .mapInArrow(pack, "block binary")
    )
    # A binary column's bytes pass unchanged as a string; the writer ends each row with the mark.
    shards.select(F.col("block").cast("string").alias("value")).write.option("lineSep", MARK.decode()).option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """part, number, position, key, first (ids of its block before it), n_tokens, ids_crc32 from the files, through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                b = Block(data.as_py())
                found = np.r_[np.arange(b.nulls), b.positions(b.keys)] if b.documents else np.zeros(0, np.int64)
                # Rows that repeat a key follow the row that the index gives.
                found = np.maximum(found, np.where(np.r_[np.zeros(b.nulls, bool), b.keys == np.r_[b.keys[:1] - 1, b.keys[:-1]]], np.arange(b.documents), found))
                if (found != np.arange(b.documents)).any():
                    raise ValueError("the index does not lead to its documents")
                crcs = [zlib.crc32(b.ids(int(i)).astype("<u4").tobytes()) for i in found]
                n = np.diff(b.offsets)[found] // b.width
                keys = pa.array([None] * b.nulls + b.keys.tolist(), pa.int64())
                yield pa.record_batch(
                    [pa.array(np.full(b.documents, b.part)), pa.array(np.full(b.documents, b.number)), pa.array(found), keys, pa.array(b.offsets[found] // b.width), pa.array(n), pa.array(crcs, pa.int64())],
                    names=["part", "number", "position", "key", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "part long, number long, position long, key long, first long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write shards, read them back: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    write_shards(docs, path, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    rows = materialise(read_shards(spark, path), "shard-rows")
    # One row a block is summed in order; blocks hold megabytes, so they are few.
    blocks = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = blocks.select("part", "number", (F.sum("n").over(Window.orderBy("part", "number")) - F.col("n")).alias("before"))
    return rows.join(before, ["part", "number"]).select(F.col("key").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), tokenizer_path("word_bpe_49k.json"))
