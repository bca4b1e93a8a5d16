"""A set of quads as a DataFrame: pattern scans, membership, insertion and deletion.

Nothing is indexed by hand: a pattern is a filter that Spark pushes to Parquet, and ``save`` lays quads out by predicate, sorted by
subject, so that a scan reads the files of its predicate and skips row groups by statistics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import QUAD, Quad, Term
from ..sources.rdf_text import quads_frame

_KEY = ["s", "p", "o", "g"]


def _is(column: str, t: Term | None) -> Column:
    if t is None:
        return F.lit(True)
    c = F.col(column)
    return (c["value"] == t.value) & (c["kind"] == t.kind) & (c["datatype"] == t.datatype) & (c["lang"] == t.lang)


class QuadStore:
    def __init__(self, quads: DataFrame, distinct: bool = False):
        """``distinct``: the caller knows that no quad is there twice, so that no shuffle is needed to make it a set."""
        self.spark = quads.sparkSession
        self.quads = quads if distinct else quads.groupBy(*_KEY).agg(F.min("ord").alias("ord")).select("ord", *_KEY)

    @classmethod
    def of(cls, spark: SparkSession, quads: Iterable[Quad] = ()) -> QuadStore:
        return cls(quads_frame(spark, quads))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls(spark.read.schema(QUAD).parquet(path).select("ord", *_KEY), distinct=True)

    def save(self, path: str, partition_by_predicate: bool = True) -> None:
        """One folder a predicate, subjects sorted within files. Without partitioning, ranges of (predicate, subject)."""
        if partition_by_predicate:
            self.quads.repartition("p").sortWithinPartitions("p", "s").write.partitionBy("p").parquet(path)
        else:
            self.quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(path)

    def match(self, s: Term | None = None, p: str | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        """The quads of a pattern, where None stands for anything. It is evaluated when it is used."""
        by_p = F.lit(True) if p is None else F.col("p") == p
        return self.quads.where(by_p & _is("s", s) & _is("o", o) & _is("g", g))

    def materialized(self, s: Term | None = None, p: str | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        return self.match(s, p, o, g).cache()

    def has_matches(self, s: Term | None = None, p: str | None = None, o: Term | None = None, g: Term | None = None) -> bool:
        return not self.match(s, p, o, g).isEmpty()

    def has(self, q: Quad) -> bool:
        return self.has_matches(q.s, q.p, q.o, q.g)

    def semi(self, quads: DataFrame) -> DataFrame:
        """Those of ``quads`` that the store has."""
        return quads.join(self.quads.select(*_KEY), _KEY, "left_semi").select("ord", *_KEY)

    def add(self, quads: DataFrame | Iterable[Quad]) -> QuadStore:
        new = quads if isinstance(quads, DataFrame) else quads_frame(self.spark, quads)
        last = self.quads.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))  # one row
        moved = new.crossJoin(F.broadcast(last)).select((F.col("ord") + F.col("last") + 1).alias("ord"), *_KEY)
        return QuadStore(self.quads.unionByName(moved))

    def delete(self, quads: DataFrame | Iterable[Quad]) -> QuadStore:
        gone = quads if isinstance(quads, DataFrame) else quads_frame(self.spark, quads)
        return QuadStore(self.quads.join(gone.select(*_KEY), _KEY, "left_anti").select("ord", *_KEY), distinct=True)

    def clear(self) -> QuadStore:
        return QuadStore(self.spark.createDataFrame([], QUAD), distinct=True)

    def size(self) -> int:
        return self.quads.count()

    def __iter__(self):
        for r in self.quads.orderBy("ord").toLocalIterator():
            yield Quad(Term(*r["s"]), r["p"], Term(*r["o"]), Term(*r["g"]))

    def candidates(self) -> DataFrame:
        """Every subject and object, with the place where it first occurs."""
        at = self.quads.select((F.col("ord") * 2).alias("ord"), F.col("s").alias("term"))
        both = at.unionByName(self.quads.select((F.col("ord") * 2 + 1).alias("ord"), F.col("o").alias("term")))
        return both.groupBy("term").agg(F.min("ord").alias("ord"))
