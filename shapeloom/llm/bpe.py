"""Byte-pair encoding and decoding over a table of distinct words.

Texts are split into words (with the white space before them; no piece of these vocabularies crosses that border). Within a
chunk, the consecutive documents of a task up to a bounded size, words are numbered, and a document becomes the list of its
words' numbers: its positions. Only the chunks' distinct words travel, packed by a hash of the word: all copies of one word meet
in one bucket, where the word is encoded once, and the ids go back to the chunks by number and are laid out by position. Decoding joins every id to its
piece in the id-to-piece table, which the vocabulary bounds, and joins the pieces' bytes.

Positions and words are made by two passes over the input with the same splits. Each document carries the CRC-32 of its text, and
the decoded text is held against it, so that an input that came in another order the second time is an error, never a wrong row.

Defined results: a null text is the empty text; null and repeated ids come out row by row; an empty table gives an empty
result; extra columns are ignored; a very long text is a chunk of its own, with any number of distinct words.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNIT, bounded_batches, byte_alphabet, load_tokenizer, table, tokenizer_path, unit_ids, whole_text

#: A chunk is closed when its texts have so many characters or so many distinct words.
CHUNK_CHARS = 24 << 20
CHUNK_WORDS = 300_000


def _chunks(batches: Iterator[pa.RecordBatch], places_too: bool) -> Iterator[tuple[int, dict[str, int], list, list[np.ndarray], list[int]]]:
    """(chunk, word -> number, ids, positions, CRCs), chunk by chunk. Positions and CRCs are made only where they are wanted."""
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    words, keys, places, crcs, size = {}, [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = UNIT.findall(text)
            keys.append(key)
            if places_too:
                number = words.setdefault
                places.append(np.array([number(w, len(words)) for w in found], dtype="<u4"))
                crcs.append(zlib.crc32(text.encode()))
            else:
                for w in found:
                    if w not in words:
                        words[w] = len(words)
            size += len(text)
            if size > CHUNK_CHARS or len(words) > CHUNK_WORDS:
                yield (task << 24) + k, words, keys, places, crcs
                words, keys, places, crcs, size, k = {}, [], [], [], 0, k + 1
    if keys:
        yield (task << 24) + k, words, keys, places, crcs


def _short(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 in seven-bit groups, least first, the top bit set on all but a number's last: common words have small
    numbers."""
    wide = np.asarray(numbers).astype(np.int64)
    there = np.stack([np.ones(len(wide), bool), *(wide >= 1 << 7 * k for k in range(1, 5))], axis=1)
    groups = np.stack([wide >> 7 * k & 127 for k in range(5)], axis=1).astype(np.uint8)
    groups[:, :4] |= there[:, 1:].astype(np.uint8) << 7
    return groups[there].tobytes()


def _long(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    value = (b[starts] & 127).astype(np.int64)
    for step in range(1, int((ends - starts).max(initial=0)) + 1):
        more = starts + step <= ends
        value[more] |= (b[starts[more] + step] & 127).astype(np.int64) << (7 * step)
    return value


def _packed(numbers: np.ndarray, parts: list[bytes]) -> bytes:
    """Ascending numbers and byte strings side by side: steps and lengths as columns, then the bytes, compressed."""
    import zstandard

    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return zstandard.ZstdCompressor(level=3).compress(b"".join((len(parts).to_bytes(4, "little"), np.diff(numbers, prepend=0).astype("<u4").tobytes(), lengths.tobytes(), *parts)))


def _unpacked(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:4], "little")
    numbers, lengths = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64), np.frombuffer(data, "<u4", n, 4 + 4 * n)
    ends = np.cumsum(lengths, dtype=np.int64) + 4 + 8 * n
    return numbers, [data[i:j] for i, j in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def distinct_words(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words): the distinct words of every chunk with their numbers, together by a hash of the word."""

    def run(batches):
        for chunk, words, *_ in _chunks(batches, False):
            if not words:
                continue
            raw = [w.encode() for w in words]
            at = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order])) + 1
            groups = np.split(order, cuts)
            for i in range(0, len(groups), 64):
                part = groups[i : i + 64]
                yield pa.record_batch(
                    [
                        pa.array([int(at[g[0]]) for g in part], pa.int32()), pa.array([chunk] * len(part), pa.int64()),
                        pa.array([_packed(g, [raw[j] for j in g.tolist()]) for g in part], pa.binary()),
                    ],
                    names=["bucket", "chunk", "words"],
                )

    return docs.mapInArrow(run, "bucket int, chunk long, words binary")


def positions(docs: DataFrame) -> DataFrame:
    """(chunk, ids, crcs, places): up to 500 documents a row, each as the numbers of its words."""

    def run(batches):
        for chunk, _, keys, places, crcs in _chunks(batches, True):
            for at in range(0, len(keys), 500):
                part = slice(at, at + 500)
                blob = _packed(np.arange(len(keys[part])), [_short(x) for x in places[part]])
                yield pa.record_batch(
                    [pa.array([chunk]), pa.array([keys[part]], pa.list_(pa.int64())), pa.array([crcs[part]], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                    names=["chunk", "ids", "crcs", "places"],
                )

    return docs.mapInArrow(run, "chunk long, ids array<long>, crcs array<long>, places binary")


def id_bytes(tokenizer: str) -> int:
    """Bytes an id takes between stages: two if no id of the vocabulary needs more."""
    return 2 if max(load_tokenizer(tokenizer).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4


def encode_words(words: DataFrame, tokenizer: str, parts: int, width: int = 4) -> DataFrame:
    """(chunk, ids): each distinct word is encoded once, where its bucket's rows have met; one bucket's words are held at a time. Ids are
    little-endian and of ``width`` bytes."""

    def run(batches):
        units = unit_ids(tokenizer, width)
        bucket, known = None, {}
        for batch in batches:
            made = []
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                numbers, found = _unpacked(data)
                for w in found:
                    if w not in known:
                        known[w] = units.encode(w.decode())
                made.append(_packed(numbers, [known[w] for w in found]))
            yield pa.record_batch([batch.column(1), pa.array(made, pa.binary())], names=["chunk", "ids"])

    met = words.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    return met.mapInArrow(run, "chunk long, ids binary")


def id_to_piece(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the bytes of every id of a byte-level vocabulary, special tokens included."""
    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = {c: b for b, c in enumerate(byte_alphabet())}
    rows = {i: piece for piece, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    made = [(i, bytearray(bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode())) for i, p in rows.items()]
    return spark.createDataFrame(made, "id int, piece binary")


class Pieces:
    """The id-to-piece table as a worker holds it: pieces end to end, and where each begins."""

    def __init__(self, rows: list):
        table_ = dict((r["id"], bytes(r["piece"])) for r in rows)
        most = max(table_, default=-1) + 1
        self.sizes = np.array([len(table_.get(i, b"")) for i in range(most)], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)][:-1]
        self.data = np.frombuffer(b"".join(table_.get(i, b"") for i in range(most)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """Each id's piece in the order of the ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[ids], sizes)
        return self.data[at].tobytes()


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` also ids (little-endian, 32 bits) and decoded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    # As many rows as the vocabulary has ids: a bound that the data do not move.
    pieces = spark.sparkContext.broadcast(id_to_piece(spark, tokenizer).collect())
    width = id_bytes(tokenizer)
    fields = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]

    def lay_out(docs_: pa.Table, words: pa.Table) -> pa.Table:
        rows = [_unpacked(x.as_py()) for x in words.column("ids")]
        ids_of = [b""] * sum(len(spelt) for _, spelt in rows)
        for numbers, spelt in rows:
            for n, x in zip(numbers.tolist(), spelt, strict=True):
                ids_of[n] = x
        table_ = Pieces(pieces.value)
        out = {f: [] for f in fields}
        each = (x for row in docs_.to_batches(1) for x in zip(row.column("ids")[0].as_py(), _unpacked(row.column("places")[0].as_py())[1], row.column("crcs")[0].as_py(), strict=True))
        for k, places, crc in each:
            found = np.frombuffer(b"".join([ids_of[i] for i in _long(places).tolist()]), f"<u{width}")
            ids, text = found.astype("<u4").tobytes(), table_.join(found).decode("utf-8", "replace").encode()
            if zlib.crc32(text) != crc:
                raise ValueError("a decoded text differs from its document: the input changed between two passes")
            row = (k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), ids, text.decode() if keep else None)
            for f, v in zip(fields, row, strict=False):
                out[f].append(v)
        return pa.table([pa.array(out[f], t) for f, t in zip(fields, types, strict=True)], names=fields)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary(), pa.string()] if keep else [])]
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    # A bucket's distinct words are held by one worker: buckets grow with the table.
    buckets = max(256, docs.count() // 5000)
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded = encode_words(distinct_words(rows, buckets), tokenizer, parts, width)
    laid = positions(rows).groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(lay_out, schema)
    return laid.withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep=False)
