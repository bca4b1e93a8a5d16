"""Token counts through a digest cache.

The cache is a table of (tokenizer, digest, n_tokens): SHA-256 digests of the vocabulary file and of the normalised content.
A run joins the documents' digests to it, encodes each missing content once, appends the new counts and answers from the cache.
Texts do not go over the network unless several rows share a missing content; such rows are grouped first, one per task.

Normalising writes U+2581 as a space, which the tokenizer itself does not tell apart; nothing else is changed.

Defined results: a null text is the empty text and has no tokens; null and repeated ids come out row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, bounded_batches, hot_keys, join_hot, map_batches, mark_passing, materialise, scratch_path, table, tokenizer_path, whole_text

_RUN = re.compile(" +[^ ]*")
_MODELS: dict[str, PieceCounts] = {}


class PieceCounts(Remembered):
    """Tokens of a word with the spaces before it. The model joins no piece across the start of a run of spaces.

    The library puts one space before a text, so a word is given to it without its first space.
    """

    def __init__(self, path: str, most: int = 600_000):
        import sentencepiece

        super().__init__(most)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: A single space at a text's end.
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def make(self, word: str) -> int:
        return len(self.model.encode(word)) if word else self.lone

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace("▁", " ")
        words = text.split(" ") if "  " not in text and text[0] != " " else [x[1:] for x in _RUN.findall(" " + text)]
        return sum(map(self.__getitem__, words))


def piece_counts(path: str) -> PieceCounts:
    if path not in _MODELS:
        _MODELS[path] = PieceCounts(path)
    return _MODELS[path]


class DigestCache:
    """Stored counts in a folder of Parquet files, one append per run."""

    SCHEMA = "tokenizer string, digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, path: str, tokenizer: str):
        self.spark, self.path, self.tokenizer = spark, path, tokenizer
        self.appended = 0

    def counts(self) -> DataFrame:
        """digest, n_tokens of this tokenizer version, one row a digest."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        stored = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return stored.where(F.col("tokenizer") == self.tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.select(F.lit(self.tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, model: str, cache: DigestCache, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens for every row of ``docs``; ``cache`` then holds every content's count."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = piece_counts(model)
        made = [counts.count(x) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(made, pa.int64())], names=["digest", "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = whole_text(text_col)
    content = F.replace(text, F.lit("▁"), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    keys = materialise(rows, "digests")
    sizes = materialise(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "contents")
    missing = materialise(sizes.join(cache.counts(), "digest", "left_anti"), "misses")
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    texts = mark_passing(mark_passing(texts, missing, "wanted"), missing.where("rows > 1"), "shared").where("wanted")
    alone = texts.where("not shared").select("digest", "content")
    once = texts.where("shared").groupBy("digest").agg(F.min("content").alias("content"))
    # A row let through by chance is known already; it is counted and dropped here.
    made = map_batches(alone.unionByName(once), encode, "digest binary, n_tokens long").join(missing, "digest", "left_semi")
    cache.append(made)
    hot = materialise(hot_keys(sizes, "digest", "rows", keys.count()), "hot")
    return join_hot(keys, cache.counts(), "digest", hot).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    cache = DigestCache(spark, scratch_path(spark, "counts"), file_digest(model))
    return token_counts(table(spark, sf_dir, "documents"), model, cache).withColumn("over_limit", F.col("n_tokens") > 4096)
