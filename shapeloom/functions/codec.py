"""Terms to native values and back, as column expressions chosen by the shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shapes import Literal, Resource, native_type
from .terms import IRI, LANG_STRING, LITERAL, TERM, XSD_STRING, constant_col, is_resource, iri_col, literal_col, number_text_col, resource_from_text, resource_text, same_term

_NATIVE = {"string": T.StringType(), "boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "term": TERM}


def node_code(shape: Resource | Literal, t: Column) -> Column:
    """0, or the code of the first thing about a term that does not fit the leaf."""
    if isinstance(shape, Resource):
        out = F.when(~(t["kind"] == IRI if shape.only_named else is_resource(t)), 221)
    else:
        out = F.when(t["kind"] != LITERAL, 221)
        if shape.datatype:
            out = out.when(t["datatype"] != shape.datatype, 223)
        if shape.language:
            out = out.when(t["lang"] != shape.language, 224)
    if shape.value is not None:
        out = out.when(~same_term(t, constant_col(shape.value)), 222)
    return out.otherwise(0)


class ValueCodec:
    """Override any of the three for other native values; ``decode`` and ``encode`` are expressions, so plans stay in the JVM."""

    def type_of(self, shape: Resource | Literal) -> T.DataType:
        return TERM

    def decode(self, shape: Resource | Literal, t: Column) -> Column:
        return t

    def encode(self, shape: Resource | Literal, c: Column) -> Column:
        return c


class NativeCodec(ValueCodec):
    def type_of(self, shape):
        if isinstance(shape, Resource):
            return TERM if shape.keep_as_term else T.StringType()
        return _NATIVE[native_type(shape)]

    def decode(self, shape, t):
        if isinstance(shape, Resource):
            return t if shape.keep_as_term else resource_text(t)
        kind = native_type(shape)
        if kind == "boolean":
            return t["value"] != "false"
        if kind == "long":
            return t["value"].try_cast("long")
        if kind == "double":
            return F.coalesce(t["value"].try_cast("double"), F.lit(float("nan")))
        return t["value"] if kind == "string" else t

    def encode(self, shape, c):
        if isinstance(shape, Resource):
            return c if shape.keep_as_term else resource_from_text(c)
        kind = native_type(shape)
        if kind == "term":
            return c
        text = c.cast("string")
        if kind == "double":
            text = number_text_col(c)
        return literal_col(text, shape.effective_datatype or XSD_STRING, shape.language if shape.effective_datatype == LANG_STRING else "")


class VocabularyCodec(ValueCodec):
    """Keys of a vocabulary for IRIs; a term or key that the vocabulary lacks is an error."""

    def __init__(self, other: ValueCodec | None = None):
        self.other = other or ValueCodec()

    @staticmethod
    def _has(shape) -> bool:
        return isinstance(shape, Resource) and shape.vocabulary is not None and not shape.keep_as_term

    def type_of(self, shape):
        return T.StringType() if self._has(shape) else self.other.type_of(shape)

    def _looked_up(self, pairs: dict[str, str], c: Column, what: str) -> Column:
        if not pairs:
            return F.raise_error(F.lit("901 the vocabulary is empty")).cast("string")
        table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
        return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit(f"901 the vocabulary has no {what} "), c)).cast("string")))

    def decode(self, shape, t):
        if not self._has(shape):
            return self.other.decode(shape, t)
        return self._looked_up({iri: key for key, iri in shape.vocabulary.terms.items()}, F.when(t["kind"] == IRI, t["value"]), "term")

    def encode(self, shape, c):
        return iri_col(self._looked_up(dict(shape.vocabulary.terms), c, "key")) if self._has(shape) else self.other.encode(shape, c)


class Chained(ValueCodec):
    """From terms: first ``a``, then ``b`` on what it gave; back: first ``b``, then ``a``. ``b`` has the type."""

    def __init__(self, a: ValueCodec, b: ValueCodec):
        self.a, self.b = a, b

    def type_of(self, shape):
        return self.b.type_of(shape)

    def decode(self, shape, t):
        return self.b.decode(shape, self.a.decode(shape, t))

    def encode(self, shape, c):
        return self.a.encode(shape, self.b.encode(shape, c))


def identity_codec() -> ValueCodec:
    return ValueCodec()


def default_codec() -> ValueCodec:
    return VocabularyCodec(NativeCodec())
