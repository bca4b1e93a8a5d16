"""What the corpus operators share: scratch tables in the shared folder, input tables, tokenizers on workers."""

from __future__ import annotations

import array
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the Unicode standard, which the tokenizers' patterns call ``\s``.
SPACE = "\t-\r \x85\xa0  -     　"
#: A word with the white space before it; white space at a text's end stands alone.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode one of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shapeloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: the rows survive lost executors and aren't made twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialise`` gave and that nothing reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/scratch/" in folder:
            delete_path(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows that the Parquet reader makes at once, and bytes of a row group that a Parquet writer fills before it writes it.
READER_ROWS, GROUP_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep what a task holds of texts small, since they can be very long: the Arrow batches sent to Python, the Parquet reader's
    batches, and the row groups of Parquet writers, which by Spark's defaults take 1 GB on 8 cores. Smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if int(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    if int(spark.conf.get("parquet.block.size", str(128 << 20))) > GROUP_BYTES:
        spark.conf.set("parquet.block.size", str(GROUP_BYTES))


def unused_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str = "doc_id") -> Column:
    """The rows that nothing is learnt from; a null id counts as the empty string."""
    return F.coalesce(F.pmod(crc32_of(column), F.lit(3)) == 1, F.lit(False))


#: Most bits of a filter over digests: at most 8 MB are broadcast whatever the data's size, and beyond some 10**8 digests more rows pass.
FILTER_BITS = 1 << 26


def mark_passing(rows: DataFrame, digests: DataFrame, name: str) -> DataFrame:
    """Adds a flag: a bitmap over ``digests``, sized by their number, lets the row's ``digest`` through. Every member passes, and few others."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (64 * digests.count()).bit_length()))
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    bitmap = digests.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))
    )


def passing(rows: DataFrame, digests: DataFrame) -> DataFrame:
    return mark_passing(rows, digests, "_passes").where("_passes").drop("_passes")


#: A key is hot if it has this share of all rows, so that at most so many of them exist.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has a key once. Rows of the ``hot`` keys, which are at most ``HOT_KEYS``, stay where they are
    and meet a broadcast part of ``side``; the others are shuffled."""
    hot = F.broadcast(hot.select(key))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, how)
    return often.unionByName(rows.join(hot, key, "left_anti").join(side, key, how))


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys of ``counts`` (key, n) that have at least one in ``HOT_KEYS`` of ``total`` rows, and more than ``HOT_KEYS`` rows."""
    return counts.where(F.col(n) >= max(HOT_KEYS, -(-total // HOT_KEYS))).select(key)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, once per worker process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


class Remembered(dict):
    """A bounded memory of computed values. When it is full it becomes the older half, from which what is asked for again
    comes back, so that frequent keys stay; ``make`` computes what neither half has."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.older = max(1, most // 2), {}

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 200:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: Letters, numbers and white space below U+0250, where there are no combining marks and lower case is one to one or known.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-\u024f]")
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable characters stand for themselves, the other bytes for U+0100 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


_ALPHABET = dict(enumerate(byte_alphabet()))


class UnitIds(Remembered):
    """Piece of text -> token ids as little-endian bytes, from the library itself, each piece encoded once per worker.

    Every pattern of these tokenizers ends its pieces where white space begins, so a text's ids are its words' ids in order. Texts of
    letters below U+0250 are cut further, into the pieces of the tokenizer's own pattern, if that is one of the two known; what is left
    to do for such a piece is the library's model alone, in the byte-level alphabet.
    """

    def __init__(self, path: str, width: int = 4, most: int = 600_000):
        super().__init__(most)
        self.tokenizer, self.width = load_tokenizer(path), width
        self.dtype, self.code = {2: ("<u2", "H"), 4: ("<u4", "I")}[width]
        made = json.loads(self.tokenizer.to_str())
        self.lower = "Lowercase" in json.dumps(made["normalizer"])
        before = json.dumps(made["pre_tokenizer"], ensure_ascii=False)
        if '"use_regex": true' in before and not made["normalizer"]:
            self.pieces = _BYTE_LEVEL
        elif r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in before and self.lower:
            self.pieces = _WORD_LEVEL
        else:
            self.pieces = None
        # Added tokens are found before the pattern cuts: where one has no mark to look for, texts are left to the library whole words at a time.
        if self.pieces and not all("<|" in x["content"] for x in made["added_tokens"]):
            self.pieces = None
        self.of_pieces = _PieceIds(self.tokenizer.model.tokenize, self.code, most) if self.pieces else None

    def make(self, unit: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        low = text.lower() if self.lower else text
        # Some letters below U+0250 have their lower case beyond it.
        if self.pieces is None or "<|" in text or not text.isascii() and (_BEYOND.search(text) or _BEYOND.search(low)):
            return b"".join(map(self.__getitem__, UNIT.findall(text)))
        return b"".join(map(self.of_pieces.__getitem__, self.pieces.findall(low)))


class _PieceIds(Remembered):
    """Piece of the tokenizer's pattern -> token ids as bytes in the machine's order, which is little-endian wherever Spark's workers run."""

    def __init__(self, tokenize: Callable, code: str, most: int):
        super().__init__(most)
        self.tokenize, self.code = tokenize, code

    def make(self, piece: str) -> bytes:
        return array.array(self.code, [x.id for x in self.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))]).tobytes()


_UNITS: dict[tuple[str, int], UnitIds] = {}


def unit_ids(path: str, width: int = 4) -> UnitIds:
    if (path, width) not in _UNITS:
        _UNITS[path, width] = UnitIds(path, width)
    return _UNITS[path, width]
