"""Shapes: the schema that says how a part of a graph becomes a nested value, and the builder that makes them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from ..functions.terms import (
    LANG_STRING, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER,
    XSD_NON_NEGATIVE, XSD_STRING, Term, lit, named,
)

INTEGERS, FRACTIONS = {XSD_INTEGER, XSD_NON_NEGATIVE}, {XSD_DECIMAL, XSD_DOUBLE}


@dataclass(frozen=True)
class Path:
    """kind: predicate, sequence (of none: the node itself), inverse, alternative, zeroOrMore, zeroOrOne, oneOrMore."""

    kind: str
    iri: str = ""
    parts: tuple[Path, ...] = ()

    @property
    def is_self(self) -> bool:
        return self.kind == "sequence" and not self.parts

    def inverted(self) -> Path:
        """The same steps backwards, with inversion at the predicates only."""
        if self.kind == "predicate":
            return Path("inverse", parts=(self,))
        if self.kind == "inverse":
            return self.parts[0].pushed()
        parts = tuple(p.inverted() for p in self.parts)
        return Path(self.kind, parts=parts[::-1] if self.kind == "sequence" else parts)

    def pushed(self) -> Path:
        """Equal, with inversion pushed down to the predicates."""
        if self.kind == "inverse":
            return self.parts[0].inverted()
        return Path(self.kind, self.iri, tuple(p.pushed() for p in self.parts))

    def __iter__(self) -> Iterator[Path]:
        return iter(self.parts)


def predicate(iri: str) -> Path:
    return Path("predicate", iri)


def as_path(x: str | Path) -> Path:
    return predicate(x) if isinstance(x, str) else x


def sequence(*parts) -> Path:
    return Path("sequence", parts=tuple(map(as_path, parts)))


def inverse(p) -> Path:
    return Path("inverse", parts=(as_path(p),))


def alternative(*parts) -> Path:
    return Path("alternative", parts=tuple(map(as_path, parts)))


def zero_or_more(p) -> Path:
    return Path("zeroOrMore", parts=(as_path(p),))


def zero_or_one(p) -> Path:
    return Path("zeroOrOne", parts=(as_path(p),))


def one_or_more(p) -> Path:
    return Path("oneOrMore", parts=(as_path(p),))


SELF = sequence()


@dataclass(frozen=True)
class Vocabulary:
    """Keys for IRIs, both ways one to one."""

    terms: Mapping[str, str]
    id: str = ""

    def __hash__(self) -> int:
        return hash((self.id, *self.terms.items()))


@dataclass(frozen=True)
class Reference:
    """The value that the shape ``target`` matched last; ``part`` is value, datatype, language or the whole."""

    target: str
    part: str = ""


@dataclass(eq=False)
class Shape:
    id: str
    lenient: bool = False

    @property
    def kind(self) -> str:
        return type(self).__name__[0].lower() + type(self).__name__[1:]

    def children(self) -> list[Shape]:
        return []

    def __repr__(self) -> str:
        return f"{self.kind}({self.id})"


@dataclass(eq=False, repr=False)
class Resource(Shape):
    only_named: bool = False
    value: Term | None = None
    keep_as_term: bool = False
    vocabulary: Vocabulary | None = None


@dataclass(eq=False, repr=False)
class Literal(Shape):
    datatype: str = ""
    language: str = ""
    value: Term | None = None
    keep_as_term: bool = False

    @property
    def effective_datatype(self) -> str:
        return self.datatype or (LANG_STRING if self.language else self.value.datatype if self.value else "")


@dataclass(eq=False, repr=False)
class Property:
    name: str
    path: Path
    shape: Shape
    transient: bool = False


@dataclass(eq=False, repr=False)
class Record(Shape):
    type_properties: list[Property] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)
    computed: list[tuple[str, Shape]] = field(default_factory=list)

    def all_properties(self) -> list[Property]:
        return [*self.type_properties, *self.properties]

    def children(self) -> list[Shape]:
        return [p.shape for p in self.all_properties()]


@dataclass(eq=False, repr=False)
class AnyOf(Shape):
    variants: list[Shape] = field(default_factory=list)

    def children(self) -> list[Shape]:
        return self.variants


@dataclass(eq=False, repr=False)
class _WithItem(Shape):
    item: Shape = None  # type: ignore[assignment]

    def children(self) -> list[Shape]:
        return [self.item]


@dataclass(eq=False, repr=False)
class Set(_WithItem):
    min_count: int | None = None
    max_count: int | None = None


@dataclass(eq=False, repr=False)
class Optional(_WithItem):
    pass


@dataclass(eq=False, repr=False)
class List(_WithItem):
    head: Path = predicate(RDF_FIRST)
    tail: Path = predicate(RDF_REST)
    nil: Term = named(RDF_NIL)


@dataclass(eq=False, repr=False)
class Map(_WithItem):
    key: Reference = None  # type: ignore[assignment]
    value: Reference | None = None


def reachable(shape: Shape) -> dict[str, Shape]:
    found, todo = {}, [shape]
    while todo:
        s = todo.pop()
        if s.id not in found:
            found[s.id] = s
            todo += s.children() + ([c for _, c in s.computed] if isinstance(s, Record) else [])
    return found


def is_recursive(shape: Shape) -> bool:
    """Whether a shape below contains itself."""
    done: set[str] = set()

    def visit(s: Shape, above: frozenset[str]) -> bool:
        if s.id in above:
            return True
        if s.id in done:
            return False
        found = any(visit(c, above | {s.id}) for c in s.children())
        done.add(s.id)
        return found

    return visit(shape, frozenset())


def captured_ids(shape: Shape) -> list[str]:
    """Ids of shapes whose last match is asked for by a map or a computed property anywhere below, in a fixed order."""
    out: list[str] = []

    def references(s: Shape) -> Iterator[str]:
        if isinstance(s, Map):
            yield s.key.target
            if s.value:
                yield s.value.target
        if isinstance(s, Record):
            for p in s.all_properties():
                if p.transient:
                    yield from open_references(p.shape)
            for _, c in s.computed:
                yield from open_references(c)

    for s in reachable(shape).values():
        for r in references(s):
            if r not in out:
                out.append(r)
    return sorted(out)


def open_references(shape: Shape) -> list[str]:
    """Ids of the leaves that synthesising ``shape`` has to look up: leaves without a constant under records and sets."""
    if isinstance(shape, Resource | Literal):
        return [] if shape.value else [shape.id]
    if isinstance(shape, Record):
        return [x for c in [*shape.children(), *(c for _, c in shape.computed)] for x in open_references(c)]
    return open_references(shape.item) if isinstance(shape, Set) else []


class ShapeBuilder:
    """Makes shapes and keeps them by id. A shape may be named before it is made: pass its id where a shape is expected."""

    def __init__(self, prefix: str = "shape"):
        self.shapes: dict[str, Shape] = {}
        self.prefix, self._numbers = prefix, itertools.count(1)
        self._late: list[tuple[Callable[[Shape], None], str]] = []

    def make_id(self, kind: str) -> str:
        return f"_:{self.prefix}_{kind}_{next(self._numbers)}"

    def get(self, id_: str) -> Shape:
        self._resolve()
        return self.shapes[id_]

    def add_all(self, shapes: list[Shape]) -> None:
        self.shapes |= {s.id: s for s in shapes}

    def _resolve(self) -> None:
        left = []
        for put, id_ in self._late:
            if id_ in self.shapes:
                put(self.shapes[id_])
            else:
                left.append((put, id_))
        self._late = left

    def _bind(self, x: Shape | str, put: Callable[[Shape], None]) -> None:
        if isinstance(x, Shape):
            put(x)
        else:
            self._late.append((put, x))

    def _keep(self, shape: Shape) -> Shape:
        self.shapes[shape.id] = shape
        self._resolve()
        return shape

    def record(self, id: str | None = None, lenient: bool = False, **fields) -> Record:
        """Fields are what ``property_``, ``self_``, ``defines_type`` and the like give; names with other characters go in ``fields={}``."""
        fields = {**fields.pop("fields", {}), **fields}
        out = Record(id or self.make_id("record"), lenient)
        for name, f in fields.items():
            f = f if isinstance(f, dict) else property_(f)
            if f["kind"] == "computed":
                out.computed.append((name, None))  # type: ignore[arg-type]
                at = len(out.computed) - 1
                self._bind(f["shape"], lambda s, at=at, name=name: out.computed.__setitem__(at, (name, s)))
                continue
            p = Property(name, f["path"], None, f["transient"])  # type: ignore[arg-type]
            self._bind(f["shape"], lambda s, p=p: setattr(p, "shape", s))
            (out.type_properties if f["kind"] == "type" else out.properties).append(p)
        return self._keep(out)

    def any_of(self, *variants: Shape | str, id: str | None = None, lenient: bool = False) -> AnyOf:
        out = AnyOf(id or self.make_id("anyOf"), lenient, [None] * len(variants))  # type: ignore[list-item]
        for i, v in enumerate(variants):
            self._bind(v, lambda s, i=i: out.variants.__setitem__(i, s))
        return self._keep(out)

    def _over(self, out: _WithItem, item: Shape | str) -> Shape:
        self._bind(item, lambda s: setattr(out, "item", s))
        return self._keep(out)

    def set_of(self, item, min_count: int | None = None, max_count: int | None = None, id: str | None = None, lenient: bool = False) -> Set:
        return self._over(Set(id or self.make_id("set"), lenient, None, min_count, max_count), item)  # type: ignore[return-value]

    def optional(self, item, id: str | None = None, lenient: bool = False) -> Optional:
        return self._over(Optional(id or self.make_id("optional"), lenient), item)  # type: ignore[return-value]

    def list_of(self, item, head=RDF_FIRST, tail=RDF_REST, nil: Term = named(RDF_NIL), id: str | None = None, lenient: bool = False) -> List:
        return self._over(List(id or self.make_id("list"), lenient, None, as_path(head), as_path(tail), nil), item)  # type: ignore[return-value]

    def map_of(self, key: Reference, value: Reference | None = None, item=None, id: str | None = None, lenient: bool = False) -> Map:
        """The item is by default the shape that the value refers to."""
        return self._over(Map(id or self.make_id("map"), lenient, None, key, value), item if item is not None else value.target)  # type: ignore[return-value,union-attr]

    def resource(self, only_named: bool = False, value: str | None = None, keep_as_term: bool = False, vocabulary: Vocabulary | None = None, id: str | None = None, lenient: bool = False) -> Resource:
        return self._keep(Resource(id or self.make_id("resource"), lenient, only_named, named(value) if value else None, keep_as_term, vocabulary))  # type: ignore[return-value]

    def literal(self, datatype: str = "", language: str = "", value: Term | str | None = None, keep_as_term: bool = False, id: str | None = None, lenient: bool = False) -> Literal:
        value = lit(value) if isinstance(value, str) else value
        return self._keep(Literal(id or self.make_id("literal"), lenient, datatype, language, value, keep_as_term))  # type: ignore[return-value]

    def resource_term(self, **more) -> Resource:
        return self.resource(keep_as_term=True, **more)

    def named_node_term(self, **more) -> Resource:
        return self.resource(only_named=True, keep_as_term=True, **more)

    def literal_term(self, **more) -> Literal:
        return self.literal(keep_as_term=True, **more)

    def constant(self, value: Term, **more) -> Shape:
        return self.resource(value=value.value, **more) if value.kind == 0 else self.literal(value=value, **more)

    def constant_term(self, value: Term, **more) -> Shape:
        return self.constant(value, keep_as_term=True, **more)

    def from_vocabulary(self, key: str, vocabulary: Vocabulary, **more) -> Resource:
        if key not in vocabulary.terms:
            raise KeyError(f"the vocabulary has no key {key!r}")
        return self.resource(value=vocabulary.terms[key], vocabulary=vocabulary, **more)

    def vocabulary(self, terms: Mapping[str, str], id: str = "") -> Vocabulary:
        return Vocabulary(dict(terms), id or self.make_id("vocabulary"))


def property_(shape, path: str | Path = SELF, kind: str = "normal", transient: bool = False) -> dict:
    return {"shape": shape, "path": as_path(path), "kind": kind, "transient": transient}


def self_(shape) -> dict:
    return property_(shape)


def inverse_property(iri: str, shape) -> dict:
    return property_(shape, inverse(iri))


def defines_type(field_or_shape) -> dict:
    f = field_or_shape if isinstance(field_or_shape, dict) else property_(field_or_shape, RDF_TYPE)
    return {**f, "kind": "type"}


def transient(f: dict) -> dict:
    return {**f, "transient": True}


def computed(shape) -> dict:
    return property_(shape, kind="computed")


def reference(target: Shape | str, part: str = "") -> Reference:
    return Reference(target if isinstance(target, str) else target.id, part)


def native_type(shape: Literal) -> str:
    """string, boolean, long, double, or term where a literal is left as it is."""
    d = shape.effective_datatype
    if shape.keep_as_term:
        return "term"
    if d == XSD_STRING or (d == LANG_STRING and shape.language):
        return "string"
    return "boolean" if d == XSD_BOOLEAN else "long" if d in INTEGERS else "double" if d in FRACTIONS else "term"
