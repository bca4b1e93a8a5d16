"""Queries over the driver's tables, each with the SQL that gives the same rows.

Every query lifts whole tables to quads and then frames, flattens or queries the graph; nothing is taken from the tables directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codec import identity_codec
from .functions.terms import RDF_FIRST, RDF_NIL, RDF_REST, XSD_DOUBLE, XSD_INTEGER, iri_col, literal_col, named, term_text_col
from .operators.flatten import flatten
from .operators.frame import frame
from .operators.lift import lift
from .operators.paths import reach, shared_folder
from .operators.query import execute, generate_query
from .operators.store import QuadStore
from .plans.shapes import (
    Shape, ShapeBuilder, Vocabulary, alternative, computed, defines_type, inverse, inverse_property, one_or_more, property_, reference, self_, sequence, transient, zero_or_more, zero_or_one,
)
from .sources.rdf_text import ntriples_lines, parse_turtle, quads_frame, quads_of, read_ntriples, read_sparql_json, turtle_text, write_ntriples

D, V = "urn:d:", "urn:v:"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "frame_nested_record"


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _iri(kind: str, *columns: str):
    return iri_col(F.concat(F.lit(f"{D}{kind}/"), F.concat_ws("/", *(F.col(c).cast("string") for c in columns))))


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def region_quads(spark: SparkSession, sf: str) -> DataFrame:
    return lift(_read(spark, sf, "region"), _iri("region", "r_regionkey"), {V + "key": "r_regionkey", V + "name": "r_name"}, V + "Region")


def nation_quads(spark: SparkSession, sf: str) -> DataFrame:
    return lift(_read(spark, sf, "nation"), _iri("nation", "n_nationkey"), {V + "key": "n_nationkey", V + "name": "n_name", V + "region": _iri("region", "n_regionkey")}, V + "Nation")


def customer_quads(spark: SparkSession, sf: str) -> DataFrame:
    columns = {V + "key": "c_custkey", V + "name": "c_name", V + "acctbal": "c_acctbal", V + "segment": "c_mktsegment", V + "nation": _iri("nation", "c_nationkey")}
    return lift(_read(spark, sf, "customer"), _iri("customer", "c_custkey"), columns, V + "Customer")


def supplier_quads(spark: SparkSession, sf: str) -> DataFrame:
    columns = {V + "key": "s_suppkey", V + "name": "s_name", V + "acctbal": "s_acctbal", V + "basedIn": _iri("nation", "s_nationkey")}
    return lift(_read(spark, sf, "supplier"), _iri("supplier", "s_suppkey"), columns, V + "Supplier")


def order_quads(spark: SparkSession, sf: str) -> DataFrame:
    columns = {V + "key": "o_orderkey", V + "status": "o_orderstatus", V + "total": "o_totalprice", V + "customer": _iri("customer", "o_custkey"), V + "priority": "o_orderpriority"}
    return lift(_read(spark, sf, "orders"), _iri("order", "o_orderkey"), columns, V + "Order")


def item_quads(spark: SparkSession, sf: str) -> DataFrame:
    t = _read(spark, sf, "lineitem")
    # Order and line do not tell rows apart, all columns do.
    node = iri_col(F.concat(F.lit(D + "item/"), F.lower(F.hex(F.xxhash64(*t.columns))), F.lit("-"), F.lower(F.hex(F.xxhash64(F.lit(1), *t.columns)))))
    return lift(t, node, {V + "order": _iri("order", "l_orderkey"), V + "quantity": "l_quantity", V + "flag": "l_returnflag"})


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _record(shape: Shape, quads: DataFrame) -> DataFrame:
    return frame(quads, shape, mode="drop").values.select("value.*")


def _kit():
    b = ShapeBuilder()
    integer, double, text = (lambda d: lambda: b.literal(datatype=d))(XSD_INTEGER), (lambda: b.literal(datatype=XSD_DOUBLE)), (lambda: b.literal(datatype="http://www.w3.org/2001/XMLSchema#string"))
    kind = lambda name: transient(defines_type(b.resource(value=V + name)))
    return b, integer, double, text, kind


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def frame_flat_record(spark, sf):
    b, integer, double, text, kind = _kit()
    s = b.record(t=kind("Customer"), c_custkey=property_(integer(), V + "key"), c_name=property_(text(), V + "name"), c_acctbal=property_(double(), V + "acctbal"), c_mktsegment=property_(text(), V + "segment"))
    return _record(s, customer_quads(spark, sf))


@query("SELECT c_custkey, c_name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def frame_nested_record(spark, sf):
    b, integer, _, text, kind = _kit()
    region = b.record(name=property_(text(), V + "name"))
    nation = b.record(name=property_(text(), V + "name"), region=property_(region, V + "region"))
    s = b.record(t=kind("Customer"), c_custkey=property_(integer(), V + "key"), c_name=property_(text(), V + "name"), nation=property_(nation, V + "nation"))
    rows = _record(s, union(customer_quads(spark, sf), nation_quads(spark, sf), region_quads(spark, sf)))
    return rows.select("c_custkey", "c_name", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query("SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def frame_sequence_path(spark, sf):
    b, integer, _, text, kind = _kit()
    s = b.record(t=kind("Customer"), c_custkey=property_(integer(), V + "key"), region=property_(text(), sequence(V + "nation", V + "region", V + "name")))
    return _record(s, union(customer_quads(spark, sf), nation_quads(spark, sf), region_quads(spark, sf)))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers FROM nation")
def frame_inverse_set(spark, sf):
    b, integer, _, text, kind = _kit()
    s = b.record(t=kind("Nation"), n_nationkey=property_(integer(), V + "key"), n_name=property_(text(), V + "name"), customers=inverse_property(V + "nation", b.set_of(b.resource())))
    rows = _record(s, union(nation_quads(spark, sf), customer_quads(spark, sf)))
    return rows.select(F.col("n_nationkey").cast("int"), "n_name", F.size("customers").cast("long").alias("n_customers"))


@query("SELECT o_orderkey, count(*) AS n_items, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) BETWEEN 3 AND 5")
def frame_set_counts(spark, sf):
    b, integer, double, _, _ = _kit()
    item = b.record(quantity=property_(double(), V + "quantity"))
    s = b.record(o_orderkey=property_(integer(), V + "key"), items=inverse_property(V + "order", b.set_of(item, min_count=3, max_count=5)))
    rows = _record(s, union(order_quads(spark, sf), item_quads(spark, sf)))
    total = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["quantity"])
    return rows.select("o_orderkey", F.size("items").cast("long").alias("n_items"), total.alias("quantity"))


@query("SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def frame_optional(spark, sf):
    b, integer, _, text, _ = _kit()
    docs = lift(_read(spark, sf, "documents").select("doc_id", "lang"), _iri("doc", "doc_id"), {V + "id": "doc_id", V + "lang": "lang"})
    labels = lift(_read(spark, sf, "labels"), _iri("doc", "doc_id"), {V + "toxic": "toxic"})
    s = b.record(doc_id=property_(integer(), V + "id"), lang=property_(text(), V + "lang"), toxic=property_(b.optional(integer()), V + "toxic"))
    return _record(s, union(docs, labels)).withColumn("toxic", F.col("toxic").cast("int"))


@query("SELECT o_orderkey, sum((l_returnflag = 'R')::INT)::BIGINT AS n_returned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def frame_lenient(spark, sf):
    b, integer, _, _, _ = _kit()
    returned = b.record(lenient=True, flag=property_(b.literal(value="R"), V + "flag"))
    s = b.record(o_orderkey=property_(integer(), V + "key"), returned=inverse_property(V + "order", b.set_of(returned)))
    return _record(s, union(order_quads(spark, sf), item_quads(spark, sf))).select("o_orderkey", F.size("returned").cast("long").alias("n_returned"))


@query("SELECT 'customer' AS kind, c_name AS name, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def frame_any_of(spark, sf):
    b, _, double, text, _ = _kit()
    kinds = Vocabulary({"customer": V + "Customer", "supplier": V + "Supplier"})
    one = lambda k: b.record(kind=defines_type(b.from_vocabulary(k, kinds)), name=property_(text(), V + "name"), amount=property_(double(), V + "acctbal"))
    return _record(b.any_of(one("customer"), one("supplier")), union(customer_quads(spark, sf), supplier_quads(spark, sf)))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_parties FROM nation")
def frame_alternative_path(spark, sf):
    b, integer, _, _, kind = _kit()
    s = b.record(t=kind("Nation"), n_nationkey=property_(integer(), V + "key"), parties=property_(b.set_of(b.resource()), alternative(inverse(V + "nation"), inverse(V + "basedIn"))))
    rows = _record(s, union(nation_quads(spark, sf), customer_quads(spark, sf), supplier_quads(spark, sf)))
    return rows.select(F.col("n_nationkey").cast("int"), F.size("parties").cast("long").alias("n_parties"))


@query("""SELECT 'urn:d:customer/' || c_custkey AS start, x.node FROM customer JOIN nation ON c_nationkey = n_nationkey,
LATERAL (SELECT unnest(['urn:d:customer/' || c_custkey, 'urn:d:nation/' || n_nationkey, 'urn:d:region/' || n_regionkey]) AS node) x""")
def path_closure(spark, sf):
    quads = union(customer_quads(spark, sf), nation_quads(spark, sf))
    step = alternative(V + "nation", V + "region")
    starts = customer_quads(spark, sf).where(F.col("p") == V + "key").select(F.col("s").alias("term"))
    return reach(spark, quads, starts, zero_or_more(step)).select(F.col("start.value").alias("start"), F.col("term.value").alias("node"))


def _turns(spark, sf):
    """Conversations whose turns are a linked list."""
    t = _read(spark, sf, "conversations")
    cell = _iri("turn", "conv_id", "turn")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    t = t.join(last, "conv_id")
    after = F.when(F.col("turn") == F.col("last"), iri_col(RDF_NIL)).otherwise(iri_col(F.concat(F.lit(D + "turn/"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string"))))
    cells = lift(t, cell, {RDF_FIRST: literal_col(F.col("role")), RDF_REST: after})
    start = iri_col(F.concat(F.lit(D + "turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("first").cast("string")))
    return union(lift(last, _iri("conv", "conv_id"), {V + "id": "conv_id", V + "turns": start}), cells)


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def frame_list(spark, sf):
    b, integer, _, text, _ = _kit()
    s = b.record(conv_id=property_(integer(), V + "id"), turns=property_(b.list_of(text()), V + "turns"))
    return _record(s, _turns(spark, sf)).select("conv_id", F.array_join("turns", ",").alias("roles"))


@query("SELECT conv_id, turn::VARCHAR AS key, role AS value FROM conversations")
def frame_map(spark, sf):
    b, integer, _, text, _ = _kit()
    turns = lift(_read(spark, sf, "conversations"), _iri("turn", "conv_id", "turn"), {V + "turn": "turn", V + "role": "role", V + "of": _iri("conv", "conv_id"), V + "conv": "conv_id"})
    heads = lift(_read(spark, sf, "conversations").select("conv_id").distinct(), _iri("conv", "conv_id"), {V + "id": "conv_id"})
    key, value = integer(), text()
    item = b.record(k=property_(key, V + "turn"), v=property_(value, V + "role"))
    s = b.record(conv_id=property_(integer(), V + "id"), turns=inverse_property(V + "of", b.map_of(reference(key), reference(value), item)))
    return _record(s, union(turns, heads)).select("conv_id", F.explode("turns"))


@query("SELECT c_custkey, n_name AS nation_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def frame_computed(spark, sf):
    b, integer, _, text, kind = _kit()
    label = text()
    nation = b.record(name=property_(label, V + "name"))
    s = b.record(t=kind("Customer"), c_custkey=property_(integer(), V + "key"), nation=property_(nation, V + "nation"), nation_name=computed(label))
    return _record(s, union(customer_quads(spark, sf), nation_quads(spark, sf))).select("c_custkey", "nation_name")


@query("SELECT r_name AS region, count(*) AS n_nations, min(n_name) AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def frame_recursive_shape(spark, sf):
    b, _, _, text, kind = _kit()
    b.record(id="urn:shape:nation", name=property_(text(), V + "name"), region=property_("urn:shape:region", V + "region"))
    s = b.record(id="urn:shape:region", t=kind("Region"), name=property_(text(), V + "name"), nations=inverse_property(V + "region", b.set_of("urn:shape:nation")))
    values = frame(union(nation_quads(spark, sf), region_quads(spark, sf)), s).values
    schema = "name string, nations array<struct<name: string, region: struct<`@use`: int>>>"
    read = values.select(F.from_json("value", schema).alias("v"))
    return read.select(F.col("v.name").alias("region"), F.size("v.nations").cast("long").alias("n_nations"), F.array_min("v.nations.name").alias("first_nation"))


@query("SELECT 223 AS code, 'acctbal' AS edge, count(*) AS n FROM customer")
def frame_errors(spark, sf):
    b, integer, _, _, kind = _kit()
    s = b.record(t=kind("Customer"), acctbal=property_(integer(), V + "acctbal"))
    quads = customer_quads(spark, sf)
    bad = frame(quads, s, mode="permissive").errors
    return bad.groupBy("code", F.element_at("stack", -1)["edge"].alias("edge")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p, count(*) AS n FROM customer, (SELECT unnest(['key', 'name', 'acctbal', 'nation', 'type']) AS p) GROUP BY p""")
def flatten_records(spark, sf):
    b, integer, double, text, kind = _kit()
    s = b.record(id_=self_(b.resource()), t=kind("Customer"), key=property_(integer(), V + "key"), name=property_(text(), V + "name"), acctbal=property_(double(), V + "acctbal"), nation=property_(b.resource(), V + "nation"))
    values = frame(customer_quads(spark, sf), s, mode="drop").values
    quads = flatten(values, s)
    return quads.groupBy(F.regexp_extract("p", "([a-z]+)$", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS lost, 0::BIGINT AS made")
def flatten_round_trip(spark, sf):
    """Framing and flattening again gives the quads that the shape covers, no more and no fewer."""
    b, integer, double, text, kind = _kit()
    item = b.record(node=self_(b.resource()), quantity=property_(double(), V + "quantity"))
    s = b.record(node=self_(b.resource()), key=property_(integer(), V + "key"), status=property_(text(), V + "status"), items=inverse_property(V + "order", b.set_of(item)))
    quads = union(order_quads(spark, sf), item_quads(spark, sf))
    again = flatten(frame(quads, s, mode="drop").values, s)
    text_of = lambda q: q.select(term_text_col(F.col("s")).alias("s"), "p", term_text_col(F.col("o")).alias("o"))
    covered = quads.where(F.col("p").isin(V + "key", V + "status")).unionByName(quads.where(F.col("p").isin(V + "order", V + "quantity")))
    marked = text_of(covered).withColumn("side", F.lit(1)).unionByName(text_of(again).withColumn("side", F.lit(2)))
    sides = marked.groupBy("s", "p", "o").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 2).alias("b"))
    return sides.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("lost"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("made"))


@query("SELECT 'urn:d:customer/' || c_custkey AS s, 'urn:v:' || p AS p, CASE p WHEN 'name' THEN c_name WHEN 'nation' THEN 'urn:d:nation/' || c_nationkey ELSE 'urn:v:Customer' END AS o FROM customer, (SELECT unnest(['name', 'nation', 'type']) AS p) UNION ALL SELECT 'urn:d:nation/' || n_nationkey, 'urn:v:name', n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def query_construct(spark, sf):
    """The query that a shape generates, run over the graph."""
    b, _, _, text, kind = _kit()
    nation = b.record(name=property_(text(), V + "name"))
    s = b.record(t=kind("Customer"), name=property_(text(), V + "name"), nation=property_(b.optional(nation), V + "nation"))
    found = execute(generate_query(s), union(customer_quads(spark, sf), nation_quads(spark, sf)))
    short = F.when(F.col("p").contains("#"), F.lit(V + "type")).otherwise(F.col("p"))
    return found.select(F.col("s.value").alias("s"), short.alias("p"), F.col("o.value").alias("o"))


@query("SELECT 'urn:d:customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 7")
def store_match(spark, sf):
    store = QuadStore(customer_quads(spark, sf), distinct=True)
    return store.match(p=V + "nation", o=named(D + "nation/7")).select(F.col("s.value").alias("s"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region WHERE r_name <> 'ASIA'")
def store_mutation(spark, sf):
    """Insert one set of quads twice, delete another; the store stays a set."""
    nations, regions = nation_quads(spark, sf), region_quads(spark, sf)
    store = QuadStore(nations).add(regions).add(nations)
    asia = store.match(p=V + "name").where(F.col("o.value") == "ASIA")
    return store.delete(asia).match(p=V + "name").select(F.col("o.value").alias("name"))


@query("SELECT count(*) AS n_terms FROM (SELECT DISTINCT n_name AS t FROM nation UNION SELECT DISTINCT 'k' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation UNION SELECT 'Nation')")
def store_candidates(spark, sf):
    return QuadStore(nation_quads(spark, sf), distinct=True).candidates().agg(F.count(F.lit(1)).alias("n_terms"))


@query("""SELECT '<urn:d:customer/' || c_custkey || '> <urn:v:name> "' || c_name || '"^^<http://www.w3.org/2001/XMLSchema#string> .' AS line FROM customer""")
def sink_ntriples(spark, sf):
    return ntriples_lines(customer_quads(spark, sf).where(F.col("p") == V + "name")).withColumnRenamed("value", "line")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pairs(spark, quads, starts, path):
    return reach(spark, quads, starts, path).select(F.col("start.value").alias("start"), F.col("term.value").alias("node"))


def _customers(spark, sf):
    return customer_quads(spark, sf).where(F.col("p") == V + "key").select(F.col("s").alias("term"))


@query("""SELECT 'urn:d:customer/' || c_custkey AS start, x.node FROM customer JOIN nation ON c_nationkey = n_nationkey,
LATERAL (SELECT unnest(['urn:d:nation/' || n_nationkey, 'urn:d:region/' || n_regionkey]) AS node) x""")
def path_one_or_more(spark, sf):
    return _pairs(spark, union(customer_quads(spark, sf), nation_quads(spark, sf)), _customers(spark, sf), one_or_more(alternative(V + "nation", V + "region")))


@query("""SELECT 'urn:d:customer/' || c_custkey AS start, x.node FROM customer,
LATERAL (SELECT unnest(['urn:d:customer/' || c_custkey, 'urn:d:nation/' || c_nationkey]) AS node) x""")
def path_zero_or_one(spark, sf):
    return _pairs(spark, customer_quads(spark, sf), _customers(spark, sf), zero_or_one(V + "nation"))


@query("SELECT DISTINCT 'urn:d:region/' || n_regionkey AS start, 'urn:d:customer/' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_inverse_sequence(spark, sf):
    regions = region_quads(spark, sf).select(F.col("s").alias("term")).distinct()
    return _pairs(spark, union(customer_quads(spark, sf), nation_quads(spark, sf)), regions, inverse(sequence(V + "nation", V + "region")))


@query("SELECT 'urn:d:customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 7")
def store_semi(spark, sf):
    """Exact membership of many quads at once: what the store does not have is left out."""
    customers = customer_quads(spark, sf)
    asked = customers.where((F.col("p") == V + "nation") & (F.col("o.value") == D + "nation/7"))
    return QuadStore(customers, distinct=True).semi(union(asked, nation_quads(spark, sf))).select(F.col("s.value").alias("s"))


@query("SELECT 'urn:d:customer/' || c_custkey AS s, c_mktsegment AS o FROM customer")
def store_saved(spark, sf):
    """A store laid out by predicate, read back, one predicate matched."""
    path = _scratch(spark, "store")
    QuadStore(customer_quads(spark, sf), distinct=True).save(path)
    return QuadStore.load(spark, path).match(p=V + "segment").select(F.col("s.value").alias("s"), F.col("o.value").alias("o"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
def store_graphs(spark, sf):
    """Each region's nations are a graph of their own; one graph is matched."""
    nations = nation_quads(spark, sf)
    regions = nations.where(F.col("p") == V + "region").select(F.col("s.value").alias("_s"), F.col("o").alias("_g"))
    placed = nations.join(regions, F.col("s.value") == F.col("_s")).select("ord", "s", "p", "o", F.col("_g").alias("g"))
    store = QuadStore(placed)
    return store.match(p=V + "name", g=named(D + "region/2")).select(F.col("o.value").alias("name"))


@query("SELECT 5::BIGINT AS regions, 0::BIGINT AS cleared, true AS has_asia, false AS has_mars FROM (SELECT 1)")
def store_probes(spark, sf):
    store = QuadStore(region_quads(spark, sf))
    asia = store.match(p=V + "name").where(F.col("o.value") == "ASIA").select("o.value").first()
    return spark.range(1).select(
        F.lit(sum(q.p == V + "name" for q in store)).cast("long").alias("regions"), F.lit(store.clear().size()).cast("long").alias("cleared"),
        F.lit(asia is not None and store.has_matches(p=V + "name")).alias("has_asia"), F.lit(store.has_matches(s=named(D + "region/mars"))).alias("has_mars"),
    )


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def source_turtle(spark, sf):
    """A graph written as Turtle and parsed again."""
    b, integer, _, text, kind = _kit()
    again = quads_frame(spark, parse_turtle(turtle_text(quads_of(nation_quads(spark, sf)), {"v": V, "d": D})))
    return _record(b.record(t=kind("Nation"), key=property_(integer(), V + "key"), name=property_(text(), V + "name")), again)


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def source_sparql_json(spark, sf):
    """Select results in several JSON files, each a document of its own."""
    b, integer, _, text, _ = _kit()
    quads = customer_quads(spark, sf).where(F.col("p").isin(V + "key", V + "name"))
    node = lambda c: F.when(c["kind"] == 0, F.struct(F.lit("uri").alias("type"), c["value"].alias("value"), F.lit(None).cast("string").alias("datatype"))).otherwise(F.struct(F.lit("literal").alias("type"), c["value"].alias("value"), c["datatype"].alias("datatype")))
    binding = F.struct(node(F.col("s")).alias("subject"), F.struct(F.lit("uri").alias("type"), F.col("p").alias("value")).alias("predicate"), node(F.col("o")).alias("object"))
    # One document holds at most a few hundred bindings: customers of one remainder of their quads' places.
    files = quads.groupBy(F.pmod(F.xxhash64("s"), F.greatest(F.lit(4), F.lit(quads.count() // 200))).alias("part")).agg(F.collect_list(binding).alias("bindings"))
    path = _scratch(spark, "results")
    parts = max(1, files.count())
    files.select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("value")).repartition(min(parts, 8)).write.text(path, lineSep="\n")
    # A file of several documents is read line by line; documents here have no line ends.
    rows = spark.read.text(path).select("value")
    single = _scratch(spark, "documents")
    rows.write.option("maxRecordsPerFile", 1).text(single)
    return _record(b.record(key=property_(integer(), V + "key"), name=property_(text(), V + "name")), read_sparql_json(spark, single))


@query("SELECT doc_id AS doc_id, text FROM documents WHERE text IS NOT NULL")
def source_ntriples(spark, sf):
    """Texts with every kind of character, written as N-Triples and read again."""
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    path = _scratch(spark, "triples")
    write_ntriples(lift(docs, _iri("doc", "doc_id"), {V + "text": "text"}), path)
    return read_ntriples(spark, path).select(F.regexp_extract("s.value", "([0-9]+)$", 1).cast("long").alias("doc_id"), F.col("o.value").alias("text"))


@query("SELECT c_name AS name, 'http://www.w3.org/2001/XMLSchema#double' AS datatype, 'urn:d:nation/' || c_nationkey AS nation FROM customer")
def frame_identity(spark, sf):
    """Framed terms as they are, without conversion."""
    b, _, double, text, _ = _kit()
    s = b.record(name=property_(text(), V + "name"), balance=property_(double(), V + "acctbal"), nation=property_(b.resource(), V + "nation"))
    rows = frame(customer_quads(spark, sf), s, mode="drop", codec=identity_codec()).values
    return rows.select(F.col("value.name.value").alias("name"), F.col("value.balance.datatype").alias("datatype"), F.col("value.nation.value").alias("nation"))


def _by_predicate(quads: DataFrame) -> DataFrame:
    short = F.regexp_extract("p", "([A-Za-z]+)$", 1)
    return quads.groupBy(short.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


@query("""SELECT x.p, x.n, x.subjects FROM (SELECT count(*) AS t, count(DISTINCT conv_id) AS c FROM conversations) s,
LATERAL (VALUES ('id', c, c), ('turns', c, c), ('first', t, t), ('rest', t, t)) x(p, n, subjects)""")
def flatten_list(spark, sf):
    b, integer, _, text, _ = _kit()
    s = b.record(conv_id=property_(integer(), V + "id"), turns=property_(b.list_of(text()), V + "turns"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    values = _read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.struct("conv_id", "turns").alias("value"))
    return _by_predicate(flatten(values, s))


@query("""SELECT x.p, x.n, x.subjects FROM (SELECT count(*) AS t, count(DISTINCT conv_id) AS c FROM conversations) s,
LATERAL (VALUES ('id', c, c), ('of', t, t), ('turn', t, t), ('role', t, t)) x(p, n, subjects)""")
def flatten_map(spark, sf):
    b, integer, _, text, _ = _kit()
    key, value = text(), text()
    item = b.record(k=property_(key, V + "turn"), v=property_(value, V + "role"))
    s = b.record(conv_id=property_(integer(), V + "id"), turns=inverse_property(V + "of", b.map_of(reference(key), reference(value), item)))
    turns = F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "role")))
    values = _read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(F.struct("conv_id", "turns").alias("value"))
    return _by_predicate(flatten(values, s))


@query("""SELECT x.p, x.n, x.subjects FROM (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS t) s, LATERAL (VALUES ('type', t, t), ('name', t, t), ('acctbal', t, t)) x(p, n, subjects)""")
def flatten_any_of(spark, sf):
    b, _, double, text, _ = _kit()
    kinds = Vocabulary({"customer": V + "Customer", "supplier": V + "Supplier"})
    one = lambda k: b.record(kind=defines_type(b.from_vocabulary(k, kinds)), name=property_(text(), V + "name"), amount=property_(double(), V + "acctbal"))
    shape = b.any_of(one("customer"), one("supplier"))
    rows = [_read(spark, sf, t).select(F.lit(t).alias("kind"), F.col(f"{c}_name").alias("name"), F.col(f"{c}_acctbal").alias("amount")) for t, c in (("customer", "c"), ("supplier", "s"))]
    return _by_predicate(flatten(union(*rows).select(F.struct("kind", "name", "amount").alias("value")), shape))


@query("""SELECT x.p, x.n, x.subjects FROM (SELECT count(*) AS t, count(DISTINCT lang) AS u FROM documents) s,
LATERAL (VALUES ('lang', (SELECT count(lang) FROM documents), (SELECT count(lang) FROM documents)), ('origin', t, t), ('maker', t, t)) x(p, n, subjects)""")
def flatten_transient(spark, sf):
    """Constants of a transient record, an optional literal, and a blank node for each of many equal values."""
    b, _, _, text, _ = _kit()
    origin = b.record(maker=property_(b.literal(value="generated"), V + "maker"))
    s = b.record(lang=property_(b.optional(text()), V + "lang"), origin=transient(property_(origin, V + "origin")))
    return _by_predicate(flatten(_read(spark, sf, "documents").select(F.struct("lang").alias("value")), s))


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("s.value").alias("s"), F.col("p"), F.col("o.value").alias("o"))


@query("""SELECT 'urn:d:customer/' || c_custkey AS s, x.p, x.o FROM customer, LATERAL (VALUES ('urn:v:name', c_name), ('urn:v:segment', c_mktsegment)) x(p, o)
UNION ALL SELECT 'urn:d:supplier/' || s_suppkey, x.p, x.o FROM supplier, LATERAL (VALUES ('urn:v:name', s_name), ('urn:v:basedIn', 'urn:d:nation/' || s_nationkey)) x(p, o)""")
def query_union(spark, sf):
    b, _, _, text, _ = _kit()
    customer = b.record(name=property_(text(), V + "name"), segment=property_(text(), V + "segment"))
    supplier = b.record(name=property_(text(), V + "name"), based=property_(b.resource(), V + "basedIn"))
    return _rows(execute(generate_query(b.any_of(customer, supplier)), union(customer_quads(spark, sf), supplier_quads(spark, sf))))


@query("""SELECT x.p, x.n, x.subjects FROM (SELECT count(*) AS t, count(DISTINCT conv_id) AS c FROM conversations) s,
LATERAL (VALUES ('id', c, c), ('turns', c, c), ('first', t, t), ('rest', t, t)) x(p, n, subjects)""")
def query_list(spark, sf):
    b, integer, _, text, _ = _kit()
    s = b.record(conv_id=property_(integer(), V + "id"), turns=property_(b.list_of(text()), V + "turns"))
    return _by_predicate(execute(generate_query(s), _turns(spark, sf)))


@query("SELECT 'name' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS subjects UNION ALL SELECT 'region', count(*), count(*) FROM nation")
def query_recursive(spark, sf):
    """Regions have nations, which have regions: the query's hop to every region that is reached through itself."""
    b, _, _, text, _ = _kit()
    b.record(id="urn:shape:nation", name=property_(text(), V + "name"), region=property_("urn:shape:region", V + "region"))
    s = b.record(id="urn:shape:region", name=property_(text(), V + "name"), nations=inverse_property(V + "region", b.set_of("urn:shape:nation")))
    return _by_predicate(execute(generate_query(s), union(nation_quads(spark, sf), region_quads(spark, sf))))


@query("SELECT 'urn:d:region/' || r_regionkey AS s, 'urn:v:name' AS p, r_name AS o FROM region WHERE r_regionkey = 2")
def query_fixed_subject(spark, sf):
    """A shape whose node can be one IRI only is asked for by that IRI."""
    b, _, _, text, _ = _kit()
    s = b.record(node=self_(b.resource(value=D + "region/2")), name=property_(text(), V + "name"))
    return _rows(execute(generate_query(s), region_quads(spark, sf)))
