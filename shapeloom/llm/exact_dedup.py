"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

``memtable`` normalises and digests a batch of rows. ``LsmIndex.insert`` flushes it: each task writes what it holds as one file sorted by
digest, with a Parquet bloom filter and min/max statistics on the digest; these files are a run of level 0. When a level has
``fanout`` runs, they are merged into one run of the next level, whose files are ranges of digests: per key the smallest identifier and
the number of rows. A digest of a batch that the runs have more than once is a hit. A filter over the hits picks the rows whose
bytes are compared: they are grouped by the digest *and* the normalised text, so that equal digests of different texts stay apart.

An index for one table keeps digests alone, since the bytes are in the table. One that takes several batches keeps the normalised
text of each distinct entry too (``bodies``), so that a later batch is verified against the bytes of the earlier ones; its results
hold for all batches inserted so far.

Defined results: a null text is the empty text; a null id is the largest, and stays only if the whole group has none; rows that repeat an id
are counted one by one and come out once each; an empty table gives an empty result; extra columns are ignored; very long texts are
digested and compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, delete_path, hot_keys, join_hot, materialise, passing, scratch_path, table, unused_name, whole_text

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def memtable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, digest) for every row: its id, its normalised text and the SHA-256 of that."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(whole_text(text_col)).alias("body"))
    return rows.withColumn("digest", F.unhex(F.sha2("body", 256)))


class LsmIndex:
    """A folder of runs. ``levels[0]`` takes flushed memtables, ``levels[k + 1]`` the merged runs of ``levels[k]``."""

    def __init__(self, spark: SparkSession, path: str, bodies: bool = True, fanout: int = 4):
        self.spark, self.path, self.bodies, self.fanout = spark, path, bodies, fanout
        self.levels: list[list[str]] = [[]]
        self.old: list[str] = []
        self.made = 0

    @property
    def key(self) -> list[str]:
        return ["digest", "body"] if self.bodies else ["digest"]

    def _write(self, rows: DataFrame, level: int) -> str:
        self.made += 1
        to = f"{self.path}/level{level}/run-{self.made:05d}"
        (
            rows.select(*self.key, "id", "n").sortWithinPartitions("digest", F.col("id").asc_nulls_last())
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "200000")
            .option("compression", "zstd")
            .parquet(to)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(to)
        return to

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "digest binary, body string, id long, n long" if self.bodies else "digest binary, id long, n long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, rows: DataFrame) -> DataFrame:
        """Flush a memtable as one run of level 0, merge levels that are full, and return the run as it was written."""
        one = rows.select(*self.key, "id", F.lit(1).cast("long").alias("n"))
        run = self._write(one, 0)
        found = self._read([run])
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self.merge(level)
            level += 1
        return found

    def merge(self, level: int) -> None:
        """Merge the runs of a level into one of the next: ranges of digests, per key the smallest id and the rows it stands for."""
        merged, self.levels[level] = self.levels[level], []
        self.old += merged
        # Tasks merge their own copies before anything is shuffled, so that a key of very many rows sends one row per task.
        distinct = self._read(merged).groupBy(*self.key).agg(F.min("id").alias("id"), F.sum("n").alias("n"))
        self._write(distinct.repartitionByRange("digest"), level + 1)

    def compact(self) -> None:
        """Merge every level into the next, so that one run is left."""
        level = 0
        while sum(map(len, self.levels[level:])) > 1 or level == 0:
            if self.levels[level]:
                self.merge(level)
            level += 1

    def vacuum(self) -> None:
        """Delete the runs that merges replaced, once no result still reads them."""
        for path in self.old:
            delete_path(self.spark, path)
        self.old = []

    def entries(self) -> DataFrame:
        """The key, id, n; a key may be in several runs."""
        return self._read([path for level in self.levels for path in level])

    def hits(self, batch: DataFrame | None = None) -> DataFrame:
        """(digest) of more than one row in all runs; with ``batch``, of its digests only, picked by a filter over them."""
        entries = self.entries() if batch is None else passing(self.entries(), batch.select("digest"))
        return entries.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")

    def lookup(self, digest: bytes) -> DataFrame:
        """Point query: bloom filters and statistics skip the row groups that cannot hold the digest."""
        return self.entries().where(F.col("digest") == F.lit(bytearray(digest)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LsmIndex | None = None) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for every row of ``docs``, which is inserted into ``index`` (one of its own if
    none is given).

    Rows that agree in id and text come out once each, and the first of them alone is kept.
    """
    spark, alone = docs.sparkSession, index is None
    rows = memtable(docs, id_col, text_col)
    if alone:
        index = LsmIndex(spark, scratch_path(spark, "lsm"), bodies=False)
        batch = index.insert(rows)
        index.compact()
        hits = materialise(index.hits(), "hits")
    else:
        before = [path for level in index.levels for path in level]
        batch = index.insert(rows)
        hits = materialise(index.hits(batch if before else None), "hits")
    suspects = passing(rows, hits)
    # Byte verification: a group is what has equal digest and equal bytes. Tasks merge their own copies first, so that a text
    # with very many copies sends one row per task.
    held = suspects.withColumn("n", F.lit(1).cast("long")) if alone else passing(index.entries(), hits)
    classes = held.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    verified = materialise(
        classes.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("classes")
        ).where("group_size > 1 or classes > 1"),
        "verified",
    )
    grouped = batch.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"))
    hot = materialise(hot_keys(verified, "digest", "group_size", batch.count()), "hot")
    if not verified.where("classes > 1").isEmpty():  # two texts share a SHA-256: their rows are told apart by their bytes
        collided = verified.where("classes > 1").select("digest")
        told = (
            suspects.join(collided, "digest", "left_semi").groupBy("digest", "body", "id").agg(F.count(F.lit(1)).alias("copies"))
            .join(classes, ["digest", "body"]).select("digest", "id", "copies", "keep_id", "group_size")
        )
        plain = join_hot(grouped.join(collided, "digest", "left_anti"), verified.drop("classes"), "digest", hot, "left")
        out = plain.select(told.columns).unionByName(told)
    else:
        out = join_hot(grouped, verified.drop("classes"), "digest", hot, "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. Rows that agree in id and text are one row."""
    marks = exact_duplicates(docs, id_col, text_col)
    gone = marks.where("group_size > 1").groupBy(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_key")).agg(
        F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_rows")
    )
    digest = unused_name(docs, "digest")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(normalised(whole_text(text_col)), 256)))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left[id_col].cast("long").eqNullSafe(right["_id"]) & (left[digest] == right["_key"])

    lost = gone.where("not _stays")
    once = keyed.join(lost, same(keyed, lost), "left_anti")
    repeated = gone.where("_stays and _rows > 1")
    if not repeated.isEmpty():
        apart = once.join(repeated, same(once, repeated), "left_semi").dropDuplicates([id_col, digest])
        once = once.join(repeated, same(once, repeated), "left_anti").unionByName(apart)
    return once.drop(digest)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
