"""Shapes written as a graph: reading them, and the shapes that describe such graphs themselves."""

from __future__ import annotations

from ..functions.terms import BLANK, LITERAL, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_INTEGER, XSD_STRING, Quad, Term, named
from .local import Graph
from .shapes import (
    AnyOf, List, Literal, Map, Optional, Path, Property, Record, Reference, Resource, Set, Shape, ShapeBuilder, Vocabulary,
    alternative, as_path, computed, defines_type, property_, reference, self_, transient, zero_or_more,
)

#: The namespace of shape files written for this library; files in another namespace with the same local names are read as well.
SHAPES = "urn:shapeloom:schema#"
KINDS = {"Record": Record, "AnyOf": AnyOf, "Set": Set, "Optional": Optional, "Resource": Resource, "Literal": Literal, "List": List, "Map": Map}
#: Fixed: the order in which the kinds of shapes are tried.
KIND_ORDER = ["Record", "AnyOf", "Set", "Optional", "Resource", "Literal", "List", "Map"]
PATHS = {"inversePath": "inverse", "alternativePath": "alternative", "zeroOrMorePath": "zeroOrMore", "zeroOrOnePath": "zeroOrOne", "oneOrMorePath": "oneOrMore"}
PARTS = {"TermDatatype": "datatype", "TermLanguage": "language", "TermValue": "value"}


def namespace_of(quads: list[Quad]) -> str:
    """The namespace whose local names the graph's types are."""
    for q in quads:
        if q.p == RDF_TYPE:
            for k in KINDS:
                if q.o.value.endswith(("#" + k, "/" + k)):
                    return q.o.value[: -len(k)]
    return SHAPES


class ShapeGraph:
    def __init__(self, quads: list[Quad], namespace: str | None = None):
        self.graph, self.ns = Graph(quads), namespace or namespace_of(quads)
        self.made: dict[Term, Shape] = {}

    def all(self, node: Term, name: str) -> list[Term]:
        return self.graph.out.get((node, self.ns + name), [])

    def one(self, node: Term, name: str) -> Term | None:
        found = self.all(node, name)
        if len(found) > 1:
            raise ValueError(f"{node} has more than one {name}")
        return found[0] if found else None

    def need(self, node: Term, name: str) -> Term:
        if (found := self.one(node, name)) is None:
            raise ValueError(f"{node} has no {name}")
        return found

    def number(self, node: Term, name: str) -> int | None:
        t = self.one(node, name)
        return None if t is None else int(t.value)

    def flag(self, node: Term, name: str) -> bool:
        t = self.one(node, name)
        return t is not None and t.value != "false"

    @staticmethod
    def id_of(node: Term) -> str:
        return f"_:{node.value}" if node.kind == BLANK else node.value

    def items(self, node: Term) -> list[Term]:
        out, seen = [], set()
        while node != named(RDF_NIL):
            if node in seen:
                raise ValueError("a list in the shape graph has no end")
            seen.add(node)
            (first,), (rest,) = self.graph.out[node, RDF_FIRST], self.graph.out[node, RDF_REST]
            out.append(first)
            node = rest
        return out

    def path(self, node: Term) -> Path:
        for name, kind in PATHS.items():
            if (inner := self.one(node, name)) is not None:
                parts = [self.path(x) for x in self.items(inner)] if kind == "alternative" else [self.path(inner)]
                return Path(kind, parts=tuple(parts))
        if node == named(RDF_NIL) or (node, RDF_FIRST) in self.graph.out:
            return Path("sequence", parts=tuple(self.path(x) for x in self.items(node)))
        if node.kind != 0:
            raise ValueError(f"{node} is no path")
        return Path("predicate", node.value)

    def vocabulary(self, node: Term | None) -> Vocabulary | None:
        if node is None:
            return None
        return Vocabulary({self.need(x, "vocabKey").value: self.need(x, "termValue").value for x in self.all(node, "vocabItem")}, self.id_of(node))

    def reference(self, node: Term | None) -> Reference | None:
        if node is None:
            return None
        part = self.one(node, "termPart")
        return Reference(self.id_of(self.need(node, "shape")), PARTS[part.value[len(self.ns) :]] if part else "")

    def properties(self, node: Term, name: str) -> list[Property]:
        return [Property(self.need(x, "name").value, self.path(self.need(x, "path")), self.shape(self.need(x, "shape")), self.flag(x, "transient")) for x in self.all(node, name)]

    def shape(self, node: Term) -> Shape:
        if node in self.made:
            return self.made[node]
        kinds = [t.value[len(self.ns) :] for t in self.graph.out.get((node, RDF_TYPE), []) if t.value.startswith(self.ns)]
        kinds = [k for k in kinds if k in KINDS]
        if len(kinds) != 1:
            raise ValueError(f"{node} is no shape")
        s = self.made[node] = KINDS[kinds[0]](self.id_of(node), self.flag(node, "lenient"))
        value = self.one(node, "termValue")
        if isinstance(s, Record):
            s.type_properties, s.properties = self.properties(node, "typeProperty"), self.properties(node, "property")
            s.computed = [(self.need(x, "name").value, self.shape(self.need(x, "shape"))) for x in self.all(node, "computedProperty")]
        elif isinstance(s, AnyOf):
            # A set of shapes is a set of unions by kind, which come in the order of the kinds, then of the graph.
            s.variants = sorted((self.shape(x) for x in self.all(node, "variant")), key=lambda v: KIND_ORDER.index(type(v).__name__))
        elif isinstance(s, Resource):
            s.only_named, s.value, s.keep_as_term, s.vocabulary = self.flag(node, "onlyNamed"), value, self.flag(node, "keepAsTerm"), self.vocabulary(self.one(node, "vocabulary"))
        elif isinstance(s, Literal):
            datatype, language = self.one(node, "termDatatype"), self.one(node, "termLanguage")
            s.datatype, s.language, s.value, s.keep_as_term = datatype.value if datatype else "", language.value if language else "", value, self.flag(node, "keepAsTerm")
        else:
            s.item = self.shape(self.need(node, "item"))
            if isinstance(s, Set):
                s.min_count, s.max_count = self.number(node, "minCount"), self.number(node, "maxCount")
            elif isinstance(s, List):
                head, tail, nil = (self.one(node, n) for n in ("headPath", "tailPath", "nil"))
                s.head, s.tail, s.nil = self.path(head) if head else s.head, self.path(tail) if tail else s.tail, nil or s.nil
            elif isinstance(s, Map):
                s.key, s.value = self.reference(self.need(node, "mapKey")), self.reference(self.one(node, "mapValue"))
        return s


def load_shapes(quads: list[Quad], namespace: str | None = None) -> dict[str, Shape]:
    """All shapes of a shape graph by id, in the order of the graph."""
    g = ShapeGraph(quads, namespace)
    nodes = [q.s for q in g.graph.quads if q.p == RDF_TYPE and q.o.value.startswith(g.ns) and q.o.value[len(g.ns) :] in KINDS]
    return {s.id: s for s in map(g.shape, dict.fromkeys(nodes))}


def root_shape(quads: list[Quad], namespace: str | None = None) -> Shape:
    """The first shape that has an IRI."""
    return next(s for id_, s in load_shapes(quads, namespace).items() if not id_.startswith("_:"))


def shapes_for_shapes(namespace: str = SHAPES) -> Shape:
    """The shape of a shape: framing a shape graph with it gives its shapes as records, which refer to each other."""
    b, ns = ShapeBuilder("meta"), namespace
    flag = lambda: b.optional(b.literal(datatype=XSD_BOOLEAN))
    term = lambda: b.optional(b.any_of(b.resource_term(), b.literal_term()))
    p = lambda name, shape: property_(shape, ns + name)

    def kind(name: str, **fields) -> Record:
        own = {"type": defines_type(b.resource(value=ns + name, vocabulary=kinds)), "id": self_(b.resource_term()), "lenient": p("lenient", flag())}
        return b.record(id=ns + name, fields={**own, **fields})

    kinds = b.vocabulary({k: ns + k for k in KINDS})
    shape, path = ns + "Shape", ns + "PropertyPath"
    one_of = lambda name: b.record(path=p(name, path))
    steps = b.list_of(path)
    parts = [b.record(id=f"{path}/{n}", fields={"type": computed(b.literal(value=k)), "path": p(n, path if k != "alternative" else steps)}) for n, k in PATHS.items()]
    inside = [ns + n for n in PATHS] + [RDF_FIRST]
    # A plain predicate has none of the other forms: what leads on from it must be an empty set.
    plain = b.record(
        id=f"{path}/predicate", fields={
            "type": computed(b.literal(value="predicate")), "iri": self_(b.named_node_term()),
            "none": transient(property_(b.set_of(b.any_of(b.resource(), b.literal()), max_count=0), alternative(*inside))),
        },
    )
    del one_of
    b.any_of(*parts, steps, plain, id=path)
    name = lambda: p("name", b.literal(datatype=XSD_STRING))
    b.record(id=ns + "Property", fields={"name": name(), "path": p("path", path), "valueShape": p("shape", shape), "transient": p("transient", flag())})
    b.record(id=ns + "ComputedProperty", fields={"name": name(), "valueShape": p("shape", shape)})
    b.record(id=ns + "ShapeReference", fields={"target": p("shape", b.resource_term()), "part": p("termPart", b.optional(b.resource(vocabulary=b.vocabulary({v: ns + k for k, v in PARTS.items()}))))})
    key, value = b.literal(datatype=XSD_STRING), b.named_node_term()
    item = b.record(key=p("vocabKey", key), value=p("termValue", value))
    vocabulary = b.record(id=ns + "Vocabulary", fields={"id": self_(b.resource_term()), "terms": p("vocabItem", b.map_of(reference(key), reference(value), item))})
    count = lambda: b.optional(b.literal(datatype=XSD_INTEGER))
    b.any_of(
        kind("Record", typeProperties=p("typeProperty", b.set_of(ns + "Property")), properties=p("property", b.set_of(ns + "Property")), computedProperties=p("computedProperty", b.set_of(ns + "ComputedProperty"))),
        kind("AnyOf", variants=p("variant", b.set_of(shape))),
        kind("Set", itemShape=p("item", shape), minCount=p("minCount", count()), maxCount=p("maxCount", count())),
        kind("Optional", itemShape=p("item", shape)),
        kind("Resource", onlyNamed=p("onlyNamed", flag()), value=p("termValue", term()), keepAsTerm=p("keepAsTerm", flag()), vocabulary=p("vocabulary", b.optional(vocabulary))),
        kind("Literal", datatype=p("termDatatype", b.optional(b.named_node_term())), language=p("termLanguage", b.optional(b.literal(datatype=XSD_STRING))), value=p("termValue", term()), keepAsTerm=p("keepAsTerm", flag())),
        kind("List", itemShape=p("item", shape), headPath=p("headPath", b.optional(path)), tailPath=p("tailPath", b.optional(path)), nil=p("nil", b.optional(b.resource_term()))),
        kind("Map", key=p("mapKey", ns + "ShapeReference"), value=p("mapValue", b.optional(ns + "ShapeReference")), itemShape=p("item", shape)),
        id=shape,
    )
    return b.get(shape)


__all__ = ["LITERAL", "SHAPES", "ShapeGraph", "as_path", "load_shapes", "namespace_of", "root_shape", "shapes_for_shapes", "zero_or_more"]
