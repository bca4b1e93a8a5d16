"""RDF terms and quads as Spark columns and as plain Python values.

A term is (kind, value, datatype, lang); what a kind does not have is the empty string, never null, so that plain equality joins
work. Equality is lexical. A quad is a row (ord, s, p, o, g); ``ord`` is its place in the input, from which results take their order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, BLANK, LITERAL, DEFAULT_GRAPH = 0, 1, 2, 3
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL, LANG_STRING = (RDF + x for x in ("type", "first", "rest", "nil", "langString"))
XSD_STRING, XSD_BOOLEAN, XSD_INTEGER, XSD_NON_NEGATIVE, XSD_DECIMAL, XSD_DOUBLE, XSD_DATETIME = (
    XSD + x for x in ("string", "boolean", "integer", "nonNegativeInteger", "decimal", "double", "dateTime")
)

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("value", T.StringType()), T.StructField("datatype", T.StringType()), T.StructField("lang", T.StringType())])
QUAD = T.StructType([T.StructField("ord", T.LongType()), T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM), T.StructField("g", TERM)])


class Term(NamedTuple):
    kind: int
    value: str
    datatype: str = ""
    lang: str = ""

    def __str__(self) -> str:
        return term_text(self)


class Quad(NamedTuple):
    s: Term
    p: str
    o: Term
    g: Term = Term(DEFAULT_GRAPH, "")


def named(iri: str) -> Term:
    return Term(IRI, iri)


def blank(label: str) -> Term:
    return Term(BLANK, label)


def lit(value: str, datatype: str = XSD_STRING, lang: str = "") -> Term:
    return Term(LITERAL, value, LANG_STRING if lang else datatype, lang)


def namespaced(namespace: str, local: str) -> str:
    return namespace + local


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f"}


def escaped(text: str) -> str:
    """Text as it stands between the quotes of a literal: control characters below U+001A and those beyond U+FFFF by number."""
    out = []
    for c in text:
        n = ord(c)
        out.append(_ESCAPES.get(c) or (f"\\u{n:04X}" if n <= 0x19 else f"\\U{n:08X}" if n > 0xFFFF else c))
    return "".join(out)


def term_text(t: Term) -> str:
    if t.kind == IRI:
        return f"<{t.value}>"
    if t.kind == BLANK:
        return f"_:{t.value}"
    if t.kind == DEFAULT_GRAPH:
        return "(default graph)"
    return f'"{escaped(t.value)}"' + (f"@{t.lang}" if t.lang else f"^^<{t.datatype}>")


def _part(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def term_col(kind: int, value, datatype="", lang="") -> Column:
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind"), _part(value).cast("string").alias("value"),
        _part(datatype).alias("datatype"), _part(lang).alias("lang"),
    )


def iri_col(value) -> Column:
    return term_col(IRI, value)


def blank_col(label) -> Column:
    return term_col(BLANK, label)


def literal_col(value, datatype=XSD_STRING, lang="") -> Column:
    return term_col(LITERAL, value, LANG_STRING if isinstance(lang, str) and lang else datatype, lang)


def constant_col(t: Term) -> Column:
    return term_col(t.kind, t.value, t.datatype, t.lang)


def default_graph() -> Column:
    return term_col(DEFAULT_GRAPH, "")


def is_resource(t: Column) -> Column:
    return t["kind"] < LITERAL


def same_term(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["value"] == b["value"]) & (a["datatype"] == b["datatype"]) & (a["lang"] == b["lang"])


def term_hash(t: Column) -> Column:
    return F.xxhash64(t["kind"], t["value"], t["datatype"], t["lang"])


def escape_col(c: Column) -> Column:
    """``escaped`` on a column. Characters beyond U+FFFF are rare: they are written one by one only where a text has any."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for k, v in _ESCAPES.items():
        if k != "\\":
            out = F.replace(out, F.lit(k), F.lit(v))
    for n in range(0x1A):
        if chr(n) not in _ESCAPES:
            out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{n:04X}"))
    units = F.split(out, "")
    by_number = F.array_join(F.transform(units, lambda x: F.when(F.octet_length(x) == 4, F.concat(F.lit("\\U"), F.lpad(F.regexp_replace(F.hex(F.encode(x, "UTF-32")), "^0+", ""), 8, "0"))).otherwise(x)), "")
    return F.when(F.octet_length(F.regexp_replace(out, "[\\x{10000}-\\x{10FFFF}]", "")) < F.octet_length(out), by_number).otherwise(out)


def term_text_col(t: Column) -> Column:
    return (
        F.when(t["kind"] == IRI, F.concat(F.lit("<"), t["value"], F.lit(">")))
        .when(t["kind"] == BLANK, F.concat(F.lit("_:"), t["value"]))
        .when(t["kind"] == DEFAULT_GRAPH, F.lit("(default graph)"))
        .when(t["lang"] != "", F.concat(F.lit('"'), escape_col(t["value"]), F.lit('"@'), t["lang"]))
        .otherwise(F.concat(F.lit('"'), escape_col(t["value"]), F.lit('"^^<'), t["datatype"], F.lit(">")))
    )


def number_text_col(c: Column) -> Column:
    """A double as text: whole numbers without a point."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.format_string("%.0f", c)).otherwise(c.cast("string"))


def resource_text(t: Column) -> Column:
    """An IRI, or a blank node's label after ``_:``."""
    return F.when(t["kind"] == BLANK, F.concat(F.lit("_:"), t["value"])).otherwise(t["value"])


def resource_from_text(c: Column) -> Column:
    return F.when(c.startswith("_:"), blank_col(F.substring(c, 3, 1 << 30))).otherwise(iri_col(c))
