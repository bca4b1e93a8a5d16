from shapeloom.functions.terms import QUAD, Quad, lit, named
from shapeloom.operators.store import QuadStore
from shapeloom.sources.rdf_text import quads_frame
from shapeloom.streaming.ingest import ingest


def test_batches_add_what_is_new(spark, tmp_path):
    a, b = (Quad(named("urn:s"), "urn:p", lit(x)) for x in "ab")
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for quads in ([a, a], [a, b]):
        quads_frame(spark, quads).write.mode("append").parquet(source)
        q = ingest(spark.readStream.schema(QUAD).parquet(source), store, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert QuadStore.load(spark, store).size() == 2
