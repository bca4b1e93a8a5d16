"""Following property paths for many nodes at once.

Input: (ctx, term), the nodes to start from. Output: (ctx, ord, term), where ord, an array of longs, gives the order of discovery.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shapes import Path


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names (one of its own only in local mode)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="shapeloom-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the plan between rounds, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """The quads of ``predicates``, written to the shared folder without a shuffle and in the order of predicates, so that a hop reads
    the row groups and columns of its own predicate, however dear ``quads`` are to make. The files stay until the folder is cleared."""
    path = f"{shared_folder(quads.sparkSession)}/quads-{uuid.uuid4().hex}"
    chosen = quads.where(F.col("p").isin(predicates)).select("ord", "s", "p", "o", "g")
    chosen.sortWithinPartitions("p").write.option("parquet.block.size", 16 << 20).parquet(path)
    return quads.sparkSession.read.schema(chosen.schema).parquet(path)


def _once(df: DataFrame) -> DataFrame:
    return df.groupBy("ctx", "term").agg(F.min("ord").alias("ord")).select("ctx", "ord", "term")


def _hop(quads: DataFrame, nodes: DataFrame, iri: str, backwards: bool) -> DataFrame:
    """One predicate: as many rows as there are quads."""
    here, there = ("o", "s") if backwards else ("s", "o")
    edges = quads.where(F.col("p") == iri).select(F.col("ord").alias("_at"), F.col(here).alias("_here"), F.col(there).alias("_there"))
    on = (F.col("term.value") == F.col("_here.value")) & (F.col("term.kind") == F.col("_here.kind"))
    if backwards:
        on = on & (F.col("term.datatype") == F.col("_here.datatype")) & (F.col("term.lang") == F.col("_here.lang"))
    return nodes.join(edges, on).select("ctx", F.concat("ord", F.array("_at")).alias("ord"), F.col("_there").alias("term"))


def follow(quads: DataFrame, nodes: DataFrame, path: Path, top: bool = True) -> DataFrame:
    """``nodes``: ctx, ord, term. A single predicate keeps equal finds (two graphs may hold one triple); other paths find a term once."""
    path = path.pushed() if top else path
    if path.kind == "predicate" or path.kind == "inverse":
        found = _hop(quads, nodes, path.iri or path.parts[0].iri, path.kind == "inverse")
        return found if top else _once(found)
    if path.kind == "sequence":
        for p in path.parts:
            nodes = follow(quads, nodes, p, top=False)
        return nodes
    if path.kind == "alternative":
        out = None
        for i, p in enumerate(path.parts):
            found = follow(quads, nodes, p, top=False).withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), "ord"))
            out = found if out is None else out.unionByName(found)
        return _once(out)
    step = path.parts[0]
    if path.kind == "zeroOrOne":
        first = nodes.withColumn("ord", F.concat(F.array(F.lit(0).cast("long")), "ord"))
        return _once(first.unionByName(follow(quads, nodes, step, top=False).withColumn("ord", F.concat(F.array(F.lit(1).cast("long")), "ord"))))
    return _closure(quads, nodes, step, path.kind == "zeroOrMore")


def _closure(quads: DataFrame, nodes: DataFrame, step: Path, with_start: bool, most_rounds: int = 10_000) -> DataFrame:
    """Round by round only what is new goes on; what was found is written, so that plans stay short and cycles end."""

    def at(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("ord", F.concat(F.array(F.lit(n).cast("long")), F.slice("ord", -1, 1)))

    found = checkpointed(_once(at(nodes, 0))) if with_start else None
    new = checkpointed(found if with_start else _once(at(follow(quads, nodes, step, top=False), 1)))
    found = new
    for n in range(2, most_rounds):
        if new.isEmpty():
            return found
        new = at(follow(quads, new, step, top=False), n)
        new = checkpointed(_once(new).join(found.select("ctx", "term"), ["ctx", "term"], "left_anti"))
        found = found.unionByName(new)
        if n % 10 == 0:
            found = checkpointed(found)
    raise RuntimeError(f"a path is longer than {most_rounds} steps")


def starts(terms: DataFrame) -> DataFrame:
    """Each term as the start of its own context."""
    return terms.select(F.col("term").alias("ctx"), F.array().cast("array<bigint>").alias("ord"), "term")


def reach(spark: SparkSession, quads: DataFrame, terms: DataFrame, path: Path) -> DataFrame:
    """(start, term) pairs of a path."""
    return follow(quads, starts(terms), path).select(F.col("ctx").alias("start"), "term")
