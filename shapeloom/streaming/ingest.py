"""Streams of quads into a stored set: each micro-batch adds what the store does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import QuadStore


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the new quads of every micro-batch to the Parquet folder ``path``, laid out by predicate. A batch that runs again adds nothing twice."""
    key = ["s", "p", "o", "g"]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = QuadStore(batch).quads
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            held = spark.read.schema(new.schema).parquet(path).join(new.select("p").distinct(), "p", "left_semi")
            new = new.join(held.select(*key), key, "left_anti").select("ord", *key)
        new.write.mode("append").partitionBy("p").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
