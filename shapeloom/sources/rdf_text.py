"""Reading and writing graphs: N-Triples and N-Quads at any size, Turtle for small files, SPARQL JSON results, JSON lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import (
    BLANK, IRI, LANG_STRING, QUAD, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER, XSD_STRING, Quad, Term,
    blank, default_graph, iri_col, lit, named, term_col, term_text_col,
)

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<iri><[^<>\s]*>)|(?P<keyword>@prefix|@base|(?i:PREFIX|BASE)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:[\w.\-]*[\w\-])"""
    r"""|(?P<double>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)|(?P<mark>\^\^|[\[\](),;.])"""
    r"""|(?P<name>[\w\-.]*:(?:[\w\-.%:]*[\w\-%:])?|a\b|true\b|false\b)""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_SIMPLE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _SIMPLE.get(m[1], m[1]), text)


class TurtleError(ValueError):
    pass


class Turtle:
    """A reader for the Turtle that people write: prefixes, lists, nested blank nodes and all forms of literals."""

    def __init__(self, text: str, label: str = "b"):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"not Turtle at {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.label, self.count = 0, {}, "", label, 0
        self.quads: list[Quad] = []

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TurtleError("the text ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def expect(self, mark: str) -> None:
        if (got := self.next()[1]) != mark:
            raise TurtleError(f"{mark!r} expected, not {got!r}")

    def fresh(self) -> Term:
        self.count += 1
        return blank(f"{self.label}{self.count}")

    def iri(self, text: str) -> str:
        text = unescaped(text[1:-1])
        return text if re.match(r"[A-Za-z][\w+.\-]*:", text) else self.base + text

    def read(self) -> list[Quad]:
        while self.at < len(self.tokens):
            kind, text = self.next()
            if kind == "keyword":
                if text.lower().lstrip("@") == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.iri(self.next()[1])
                else:
                    self.base = self.iri(self.next()[1])
                if text[0] == "@":
                    self.expect(".")
                continue
            self.at -= 1
            alone = self.peek() == "["
            subject = self.term()
            if not (alone and self.peek() == "."):
                self.properties(subject)
            self.expect(".")
        return self.quads

    def properties(self, subject: Term) -> None:
        while True:
            kind, text = self.next()
            verb = RDF_TYPE if text == "a" else self.resource(kind, text).value
            while True:
                # An object's own statements follow the statement that mentions it.
                at = len(self.quads)
                self.quads.append(None)  # type: ignore[arg-type]
                self.quads[at] = Quad(subject, verb, self.term())
                if self.peek() != ",":
                    break
                self.next()
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.next()
            if self.peek() in (".", "]", ""):
                return

    def resource(self, kind: str, text: str) -> Term:
        if kind == "iri":
            return named(self.iri(text))
        if kind == "blank":
            return blank(text[2:])
        prefix, colon, local = text.partition(":")
        if not colon or prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix in {text!r}")
        return named(self.prefixes[prefix] + local)

    def term(self) -> Term:
        kind, text = self.next()
        if text == "[":
            node = self.fresh()
            if self.peek() != "]":
                self.properties(node)
            self.expect("]")
            return node
        if text == "(":
            return self.items()
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            value = unescaped(text[n:-n])
            if self.peek().startswith("@") and self.tokens[self.at][0] == "lang":
                return Term(2, value, LANG_STRING, self.next()[1][1:])
            if self.peek() == "^^":
                self.next()
                return lit(value, self.resource(*self.next()).value)
            return lit(value)
        if kind in ("integer", "decimal", "double"):
            return lit(text, {"integer": XSD_INTEGER, "decimal": XSD_DECIMAL, "double": XSD_DOUBLE}[kind])
        if text in ("true", "false"):
            return lit(text, XSD_BOOLEAN)
        return self.resource(kind, text)

    def items(self) -> Term:
        first = last = None
        while self.peek() != ")":
            node = self.fresh()
            if last is None:
                first = node
            else:
                self.quads.append(Quad(last, RDF_REST, node))
            at = len(self.quads)
            self.quads.append(None)  # type: ignore[arg-type]
            self.quads[at] = Quad(node, RDF_FIRST, self.term())
            last = node
        self.next()
        if last is None:
            return named(RDF_NIL)
        self.quads.append(Quad(last, RDF_REST, named(RDF_NIL)))
        return first  # type: ignore[return-value]


def parse_turtle(text: str) -> list[Quad]:
    return Turtle(text).read()


def quads_frame(spark: SparkSession, quads: Iterable[Quad]) -> DataFrame:
    """Quads of the driver as a frame, by Arrow, so that no Python worker is needed to read them."""
    term = pa.struct([("kind", pa.int8()), ("value", pa.string()), ("datatype", pa.string()), ("lang", pa.string())])
    schema = pa.schema([("ord", pa.int64()), ("s", term), ("p", pa.string()), ("o", term), ("g", term)])
    rows = [{"ord": i, "s": q.s._asdict(), "p": q.p, "o": q.o._asdict(), "g": q.g._asdict()} for i, q in enumerate(quads)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema), QUAD) if rows else spark.createDataFrame([], QUAD)


def quads_of(df: DataFrame) -> list[Quad]:
    """A small frame's quads in order, on the driver (shape files, pretty printing)."""
    return [Quad(Term(*r["s"]), r["p"], Term(*r["o"]), Term(*r["g"])) for r in df.orderBy("ord").collect()]


_NODE = r"(<[^>]*>|_:[^\s]+)"
# A literal ends at the last quote after which the line is whole: no step per character, so that texts may be of any length.
_LITERAL = r'("[\s\S]*"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_NODE}\s*<([^>]*)>\s*(?:{_NODE}|{_LITERAL})\s*{_NODE}?\s*\.\s*(?:#.*)?$"


def _unescape_col(c):
    """Escapes are rare; a text with a number escape is taken apart, all others are left alone."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)

    def one(x):
        out = F.when(x.rlike(r"^\\[uU]"), F.decode(F.unhex(F.lpad(F.regexp_replace(x, r"^\\[uU]0*", ""), 8, "0")), "UTF-32"))
        for k, v in _SIMPLE.items():
            out = out.when(x == "\\" + k, F.lit(v))
        return out.when(x.startswith("\\"), F.substring(x, 2, 1 << 30)).otherwise(x)

    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads files as quads, parsed on the executors. ``ord`` grows along each file; lines that aren't quads are an error."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord")).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    node = lambda c: F.when(c.startswith("<"), iri_col(_unescape_col(F.regexp_extract(c, "^<(.*)>$", 1)))).otherwise(term_col(BLANK, F.substring(c, 3, 1 << 30)))
    text, lang, datatype = (F.regexp_extract(part(4), r, 1) for r in (r'(?s)^"(.*)"', r'"@([A-Za-z0-9\-]+)$', r'"\^\^<([^>]*)>$'))
    literal = term_col(2, _unescape_col(text), F.when(lang != "", F.lit(LANG_STRING)).when(datatype != "", datatype).otherwise(F.lit(XSD_STRING)), lang)
    checked = F.when(F.col("value").rlike(_LINE), part(2)).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), F.substring("value", 1, 200))))
    return lines.select(
        "ord", node(part(1)).alias("s"), checked.alias("p"), F.when(part(3) != "", node(part(3))).otherwise(literal).alias("o"),
        F.when(part(5) != "", node(part(5))).otherwise(default_graph()).alias("g"),
    )


def ntriples_lines(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("g.kind") == 3, F.lit("")).otherwise(F.concat(F.lit(" "), term_text_col(F.col("g"))))
    return quads.select(F.concat(term_text_col(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), term_text_col(F.col("o")), graph, F.lit(" .")).alias("value"))


def write_ntriples(quads: DataFrame, path: str) -> None:
    ntriples_lines(quads).write.text(path)


def read_sparql_json(spark: SparkSession, path: str) -> DataFrame:
    """SELECT ?subject ?predicate ?object results as quads."""
    node = "struct<type: string, value: string, datatype: string, `xml:lang`: string>"
    rows = spark.read.schema(f"results struct<bindings: array<struct<subject: {node}, predicate: {node}, object: {node}>>>").json(path, multiLine=True)
    # Files in the order of their names' hashes, each with its bindings in order, so that no two quads of a folder share a place.
    file = F.shiftleft(F.pmod(F.xxhash64(F.input_file_name()), F.lit(1 << 30)), 32)
    b = rows.select(file.alias("file"), F.posexplode("results.bindings").alias("i", "b")).withColumn("ord", F.col("file") + F.col("i"))

    def term(name: str):
        c = F.col(f"b.{name}")
        kind = F.when(c["type"] == "uri", F.lit(IRI)).when(c["type"] == "bnode", F.lit(BLANK)).otherwise(F.lit(2)).cast("tinyint")
        lang = F.coalesce(c["xml:lang"], F.lit(""))
        datatype = F.when(kind < 2, F.lit("")).when(lang != "", F.lit(LANG_STRING)).otherwise(F.coalesce(c["datatype"], F.lit(XSD_STRING)))
        return F.struct(kind.alias("kind"), c["value"].alias("value"), datatype.alias("datatype"), lang.alias("lang"))

    return b.select(F.col("ord").cast("long").alias("ord"), term("subject").alias("s"), F.col("b.predicate.value").alias("p"), term("object").alias("o"), default_graph().alias("g"))


def write_json(values: DataFrame, path: str) -> None:
    """Framed values as JSON lines."""
    values.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def grouped_blanks(quads: list[Quad]) -> Iterator[tuple[Quad, list]]:
    """Quads of subjects that stand alone, and under each the groups of blank nodes that are an object once."""
    uses: dict[Term, int] = {}
    own: dict[Term, list[int]] = {}
    for i, q in enumerate(quads):
        uses[q.o] = uses.get(q.o, 0) + (q.o.kind == BLANK)
        own.setdefault(q.s, []).append(i)
    inside = {t: at for t, at in own.items() if t.kind == BLANK and uses.get(t) == 1}
    # A node nested in itself has no outside: it is written by its label.
    parent = {q.o: q.s for q in quads if q.o in inside}
    for t in list(inside):
        up, seen = parent.get(t), {t}
        while up in inside and up not in seen:
            seen.add(up)
            up = parent.get(up)
        if up in seen:
            inside.pop(t)

    def nested(t: Term) -> list | None:
        if t not in inside:
            return None
        return [(quads[i], nested(quads[i].o)) for i in inside[t]]

    for q in quads:
        if q.s not in inside:
            yield q, nested(q.o)


def turtle_text(quads: list[Quad], prefixes: dict[str, str] | None = None) -> str:
    """Turtle with nested blank nodes and lists, for small graphs."""
    prefixes = prefixes or {}

    def name(t: Term) -> str:
        if t.kind == IRI:
            for p, ns in prefixes.items():
                if t.value.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w\-]*", t.value[len(ns) :]):
                    return f"{p}:{t.value[len(ns) :]}"
        if t.kind == 2 and t.datatype == XSD_STRING:
            return str(t).rpartition("^^")[0]
        return str(t)

    def items(group: list | None) -> list | None:
        """The items of a well-formed list, or None."""
        out = []
        while group is not None:
            if [q.p for q, _ in group] != [RDF_FIRST, RDF_REST]:
                return None
            out.append(group[0])
            if group[1][0].o == named(RDF_NIL):
                return out
            group = group[1][1]
        return None

    def value(q: Quad, group: list | None, indent: str) -> str:
        if group is None:
            return name(q.o)
        if (listed := items(group)) is not None:
            return "(" + " ".join(value(x, g, indent) for x, g in listed) + ")"
        inner = indent + "  "
        return "[\n" + ";\n".join(f"{inner}{verb(x)} {value(x, g, inner)}" for x, g in group) + f"\n{indent}]"

    def verb(q: Quad) -> str:
        return "a" if q.p == RDF_TYPE else name(named(q.p))

    out = [f"@prefix {p}: <{ns}>." for p, ns in prefixes.items()]
    last = None
    for q, group in grouped_blanks(quads):
        line = f"{verb(q)} {value(q, group, '  ')}"
        if q.s == last:
            out[-1] = out[-1][:-1] + ";"
            out.append(f"  {line}.")
        else:
            out.append(f"{name(q.s)} {line}.")
        last = q.s
    return "\n".join(out) + "\n"


def read_cyclic_json(text: str):
    from ..plans.local import from_json

    return from_json(json.loads(text))
