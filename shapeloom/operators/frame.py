"""Framing: shapes compiled to DataFrame plans that turn quads into nested values.

A shape is compiled to a plan from candidates (ctx, ord, term) to outcomes (ctx, ord, term, ok, value, fatal, err, one column for each
capture). A context is the node that asked. Leaves are expressions on the candidate. Records and lists depend on their term only,
so they are computed once per distinct term and joined back. Sets, maps and optionals gather per context; what they give
where a context has no candidates is known beforehand, so contexts without rows need no plan.

A record whose properties are single predicates with leaf values, the common case, is one aggregation over the quads (a pivot)
with no join at all; other properties add one join each, for the terms that fit the type properties only.

What a plan would use several times is written to the shared folder once, so that plans grow with the number of properties and not
with a power of the depth: the quads of a shape that is not flat (``stage=False`` leaves that out, for quads that are laid out by
predicate already), each record's pivot, and the candidates of properties with records, lists or unions in them.

``mode``: "failfast" raises the first error of a required part; "drop" leaves such roots out and carries no error columns, which
is the fastest; "permissive" returns values and errors in two frames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import ValueCodec, default_codec, node_code
from ..functions.terms import LITERAL, TERM, Quad, Term, constant_col, is_resource, same_term, term_text_col
from ..plans.errors import ShapeError, shown
from ..plans.local import Framer, Graph, as_json
from ..plans.shapes import (
    SELF, AnyOf, List, Literal, Map, Optional, Path, Property, Record, Reference, Resource, Set, Shape, captured_ids, is_recursive, reachable,
)
from .paths import checkpointed, follow, staged, starts

FRAME = "struct<edge: string, shape: string, focus: string>"
ERR = f"struct<code: int, stack: array<{FRAME}>>"


def _frame_col(shape: Shape, focus: Column | None = None, edge: str | None = None) -> Column:
    return F.struct(
        F.lit(edge).cast("string").alias("edge"), F.lit(shown(shape)).alias("shape"), (F.lit(None) if focus is None else focus).cast("string").alias("focus")
    )


@dataclass
class Static:
    """What a shape gives for no candidates: one entry per match, or a mismatch with a code."""

    matches: list[Column]
    code: int = 0


class Compiler:
    """With ``errors`` every outcome that does not fit says why; ``fatal`` says whether that is an error of the whole."""

    shapes: dict[str, Shape]

    def __init__(self, quads: DataFrame, codec: ValueCodec, errors: bool, captures: list[str]):
        self.quads = self.all_quads = quads
        self.codec, self.errors, self.captures = codec, errors, captures
        self.types: dict[str, T.DataType] = {}

    # -- helpers ---------------------------------------------------------------------------------------------------------

    def cap(self, id_: str) -> str:
        return f"cap_{self.captures.index(id_)}"

    @property
    def caps(self) -> list[str]:
        return [f"cap_{i}" for i in range(len(self.captures))]

    def own_caps(self, shape: Shape, term: Column) -> list[Column]:
        return [(term if id_ == shape.id else F.lit(None)).cast(TERM).alias(self.cap(id_)) for id_ in self.captures]

    def err(self, code, stack: Column | None) -> Column:
        if not self.errors:
            return F.lit(None).cast(ERR).alias("err")
        code = F.lit(code) if isinstance(code, int) else code
        return F.when(code != 0, F.struct(code.cast("int").alias("code"), stack.alias("stack")).cast(ERR)).alias("err")

    def under(self, err: Column, frame: Column, edge: str | None = None) -> Column:
        """An error seen from one shape further up, whose property ``edge`` leads to it."""
        stack = F.transform(err["stack"], lambda x, i: F.when(i == 0, F.struct(F.lit(edge).alias("edge"), x["shape"].alias("shape"), x["focus"].alias("focus")).cast(FRAME)).otherwise(x)) if edge is not None else err["stack"]
        return F.when(err.isNotNull(), F.struct(err["code"].alias("code"), F.concat(F.array(frame.cast(FRAME)), stack).alias("stack")).cast(ERR))

    def gathered(self, found: DataFrame, keys: list[str]) -> list[Column]:
        """Aggregates over outcomes: counts, whether one is fatal, the first error, and the last captures."""
        del found, keys
        first = F.min(F.when(F.col("err").isNotNull(), F.struct("ord", "err")))["err"] if self.errors else F.lit(None).cast(ERR)
        return [
            F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"), F.coalesce(F.bool_or("fatal"), F.lit(False)).alias("fatal"), first.alias("err"),
            *(F.max(F.when(F.col("ok") & F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("t"))))["t"].alias(c) for c in self.caps),
        ]

    def static(self, shape: Shape) -> Static:
        if shape.lenient:
            s = self._static(shape)
            return s if not s.code else Static([])
        return self._static(shape)

    def _static(self, shape: Shape) -> Static:
        kind = self.type_of(shape)
        if isinstance(shape, Set):
            item = self.static(shape.item)
            if item.code:
                return item
            n = len(item.matches)
            if shape.min_count is not None and n < shape.min_count:
                return Static([], 219)
            if shape.max_count is not None and n > shape.max_count:
                return Static([], 220)
            return Static([(F.array(*item.matches) if n else F.array()).cast(kind)])
        if isinstance(shape, Map):
            return Static([F.create_map().cast(kind)])
        if isinstance(shape, Optional):
            return Static(self.static(shape.item).matches or [F.lit(None).cast(kind)])
        if isinstance(shape, AnyOf):
            return Static([self.widened(v, m, kind) for v in shape.variants for m in self.static(v).matches])
        return Static([])

    # -- types -----------------------------------------------------------------------------------------------------------

    def type_of(self, shape: Shape) -> T.DataType:
        if shape.id not in self.types:
            self.types[shape.id] = self._type_of(shape)
        return self.types[shape.id]

    def _type_of(self, shape: Shape) -> T.DataType:
        if isinstance(shape, Resource | Literal):
            return self.codec.type_of(shape)
        if isinstance(shape, Record):
            fields = [(p.name, p.shape) for p in shape.all_properties() if not p.transient] + list(shape.computed)
            return T.StructType([T.StructField(n, self.type_of(s)) for n, s in fields])
        if isinstance(shape, AnyOf):
            kinds = [self.type_of(v) for v in shape.variants]
            return kinds[0] if all(k == kinds[0] for k in kinds) else T.VariantType()
        if isinstance(shape, Set | List):
            return T.ArrayType(self.type_of(shape.item))
        if isinstance(shape, Map):
            return T.MapType(T.StringType(), self.reference_type(shape.value) if shape.value else self.type_of(shape.item))
        return self.type_of(shape.item)

    def reference_type(self, ref: Reference) -> T.DataType:
        target = self.shapes[ref.target]
        if ref.part:
            return TERM if ref.part == "datatype" else T.StringType()
        return self.codec.type_of(target) if isinstance(target, Resource | Literal) else TERM

    def widened(self, shape: Shape, value: Column, to: T.DataType) -> Column:
        kind = self.type_of(shape)
        if kind == to or not isinstance(to, T.VariantType):
            return value
        return F.to_variant_object(value) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else value.cast("variant")

    # -- outcomes --------------------------------------------------------------------------------------------------------

    def outcomes(self, shape: Shape, cands: DataFrame, required: bool) -> DataFrame:
        required = required and not shape.lenient
        out = getattr(self, f"_{shape.kind}")(shape, cands, required)
        return out.where("ok") if shape.lenient else out

    def _leaf(self, shape, cands: DataFrame, required: bool) -> DataFrame:
        term = F.col("term")
        code = node_code(shape, term)
        stack = F.array(_frame_col(shape, term_text_col(term)))
        err = self.err(code, stack) if self.errors else self.err(0, None)
        return cands.select(
            "ctx", "ord", "term", (code == 0).alias("ok"), F.when(code == 0, self.codec.decode(shape, term)).alias("value"),
            (F.lit(required) & (code != 0)).alias("fatal"), err.alias("err"), *self.own_caps(shape, term),
        )

    _resource = _literal = _leaf

    def _per_term(self, cands: DataFrame, made: DataFrame) -> DataFrame:
        keep = [c for c in made.columns if c != "term"]
        joined = cands.select("ctx", "ord", F.col("term")).join(made.withColumnRenamed("term", "_term"), same_term(F.col("term"), F.col("_term")))
        return joined.select("ctx", "ord", "term", *keep)

    def _record(self, shape: Record, cands: DataFrame, required: bool) -> DataFrame:
        if all(self.is_simple(p) for p in (*shape.type_properties, *shape.properties)):
            # One pivot and nothing else: candidates are joined with it as they are, which saves making them distinct and joining back.
            return self.records(shape, cands.select("ctx", "ord", "term"), required)
        return self._per_term(cands, self.records(shape, cands.select("term").distinct(), required))

    def is_simple(self, p: Property) -> bool:
        one = p.path.kind == "predicate" or (p.path.kind == "inverse" and p.path.parts[0].kind == "predicate")
        return one and isinstance(p.shape, Resource | Literal) and not p.shape.lenient and p.path.kind == "predicate"

    def records(self, shape: Record, terms: DataFrame | None, required: bool) -> DataFrame:
        """One row per row of ``terms`` (None: per subject): term, ok, value, fatal, err, captures, and ord if ``terms`` is None, or
        ctx and ord if ``terms`` has them."""
        strict = required or bool(shape.type_properties)
        props = [(p, required) for p in shape.type_properties] + [(p, strict) for p in shape.properties]
        n_type = len(shape.type_properties)
        simple = [i for i, (p, _) in enumerate(props) if self.is_simple(p)]
        if terms is None and not simple:
            q = self.all_quads
            everything = q.select(F.col("s").alias("term"), (F.col("ord") * 2).alias("ord")).unionByName(q.select(F.col("o").alias("term"), (F.col("ord") * 2 + 1).alias("ord")))
            base = everything.groupBy("term").agg(F.min("ord").alias("ord"))
        elif simple:
            pivot = self._pivot(props, simple)
            if terms is None:
                base = pivot
            else:
                base = terms.join(pivot.drop("ord").withColumnRenamed("term", "_term"), same_term(F.col("term"), F.col("_term")), "left").drop("_term")
                for i in simple:
                    base = base.withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(0).cast("long"))).withColumn(f"b{i}", F.coalesce(f"b{i}", F.lit(0).cast("long")))
        else:
            base = terms
        rest = [i for i in range(len(props)) if i not in simple]
        if rest and simple:
            base = checkpointed(base)  # read once for itself and once for each of the others
        fits = lambda i: (F.col(f"n{i}") == 1) & (F.col(f"b{i}") == 0)
        # Candidates of the other properties are the terms that fit the simple type properties, taken from the first step, so that no
        # property's plan has another's in it.
        alive = base.where(is_resource(F.col("term")))
        if before := [j for j in range(n_type) if j in simple]:
            alive = alive.where(reduce(Column.__and__, [fits(j) for j in before]))
        alive = alive.select("term")
        for i in rest:
            p, need = props[i]
            base = base.join(self._property(p, alive, need, i).withColumnRenamed("term", "_term"), same_term(F.col("term"), F.col("_term")), "left").drop("_term")
            base = self._filled(base, p, i, need)
        focus = term_text_col(F.col("term")) if self.errors else None
        me = _frame_col(shape, focus)
        code = F.when(~is_resource(F.col("term")), F.lit(205))
        ok, fatal, err = is_resource(F.col("term")), F.when(~is_resource(F.col("term")), F.lit(required)), F.when(~is_resource(F.col("term")), self.err(205, F.array(me)))
        for i, (p, need) in enumerate(props):  # the first property that does not fit decides
            bad = ~fits(i)
            ok = ok & ~bad
            inner = F.col(f"f{i}")
            fatal = fatal.when(bad, inner | F.lit(need))
            code = F.when(F.col(f"b{i}") > 0, 202).when(F.col(f"n{i}") == 0, 203).otherwise(204)
            err = err.when(bad, F.coalesce(self.under(F.col(f"e{i}"), me, p.name), self.err(code, F.array(me)))) if self.errors else err
        caps = [F.coalesce(*(F.col(f"{c}_{i}") for i in reversed(range(len(props)))), F.lit(None).cast(TERM)) for c in self.caps]
        row = {c: v for c, v in zip(self.captures, caps, strict=True)}
        fields = [F.col(f"v{i}").alias(p.name) for i, (p, _) in enumerate(props) if not p.transient]
        fields += [self.codec_synthesise(s, row).alias(n) for n, s in shape.computed]
        value = F.struct(*fields) if fields else F.struct()
        own = [F.coalesce(F.when(F.lit(id_ == shape.id), F.col("term")), v).alias(self.cap(id_)) for id_, v in zip(self.captures, caps, strict=True)]
        fatal = F.coalesce(fatal, F.lit(False))
        err = err if self.errors else F.lit(None).cast(ERR)
        at = [c for c in base.columns if c in ("ctx", "ord")]
        # Values are made for records that fit only, so that synthesis does not fail for others.
        return base.select("term", *at, ok.alias("ok"), F.when(ok, value).alias("value"), fatal.alias("fatal"), err.alias("err"), *own)

    def _filled(self, base: DataFrame, p: Property, i: int, need: bool) -> DataFrame:
        """Terms for which the property's path led nowhere have what its shape gives for no candidates."""
        s = self.static(p.shape)
        none = F.col(f"n{i}").isNull()
        n, b = len(s.matches), int(bool(s.code))
        value = s.matches[0] if n == 1 else F.lit(None)
        out = base.withColumn(f"v{i}", F.when(none, value.cast(self.type_of(p.shape))).otherwise(F.col(f"v{i}")))
        if self.errors and s.code:
            out = out.withColumn(f"e{i}", F.when(none, self.err(s.code, F.array(_frame_col(p.shape)))).otherwise(F.col(f"e{i}")))
        out = out.withColumn(f"f{i}", F.coalesce(f"f{i}", F.lit(need and bool(s.code))))
        return out.withColumn(f"b{i}", F.when(none, b).otherwise(F.col(f"b{i}"))).withColumn(f"n{i}", F.coalesce(f"n{i}", F.lit(n)))

    def _pivot(self, props: list[tuple[Property, bool]], simple: list[int]) -> DataFrame:
        """All simple properties of all subjects in one aggregation."""
        o, aggs = F.col("o"), [F.min("ord").alias("ord")]
        for i in simple:
            p, need = props[i]
            here = F.col("p") == p.path.iri
            code = node_code(p.shape, o)
            good = here & (code == 0)
            aggs += [F.count_if(good).alias(f"n{i}"), F.count_if(here & (code != 0)).alias(f"b{i}")]
            value = self.codec.decode(p.shape, o)
            # With exactly one match, which is checked, min is that match.
            aggs.append(F.min(F.when(good, value)).alias(f"v{i}") if not isinstance(self.type_of(p.shape), T.VariantType) else F.first(F.when(good, value), ignorenulls=True).alias(f"v{i}"))
            if self.errors:
                bad = F.min(F.when(here & (code != 0), F.struct("ord", code.alias("code"), term_text_col(o).alias("focus"))))
                aggs.append(F.when(bad.isNotNull(), F.struct(bad["code"].cast("int").alias("code"), F.array(_frame_col(p.shape, bad["focus"])).alias("stack")).cast(ERR)).alias(f"e{i}"))
            else:
                aggs.append(F.first(F.lit(None).cast(ERR)).alias(f"e{i}"))
            aggs.append(F.lit(False).alias(f"f{i}"))
            aggs += [(F.max(F.when(good, F.struct("ord", o.alias("t"))))["t"] if id_ == p.shape.id else F.lit(None).cast(TERM)).alias(f"{self.cap(id_)}_{i}") for id_ in self.captures]
        wanted = list(dict.fromkeys(props[i][0].path.iri for i in simple))
        return self.quads.where(F.col("p").isin(wanted)).groupBy("s").agg(*aggs).withColumnRenamed("s", "term")

    def _property(self, p: Property, terms: DataFrame, need: bool, i: int) -> DataFrame:
        cands = follow(self.quads, starts(terms), p.path)
        found = self.outcomes(p.shape, checkpointed(cands) if _reads_twice(p.shape) else cands, need)
        value = F.max_by(F.when(F.col("ok"), F.struct(F.col("value").alias("x"))), F.when(F.col("ok"), F.col("ord")))["x"]
        got = found.groupBy("ctx").agg(*self.gathered(found, ["ctx"]), value.alias("value"))
        return got.select(
            F.col("ctx").alias("term"), F.col("n_ok").alias(f"n{i}"), F.col("n_bad").alias(f"b{i}"), F.col("value").alias(f"v{i}"),
            F.col("fatal").alias(f"f{i}"), F.col("err").alias(f"e{i}"), *(F.col(c).alias(f"{c}_{i}") for c in self.caps),
        )

    def _anyOf(self, shape: AnyOf, cands: DataFrame, required: bool) -> DataFrame:
        """Every variant sees all candidates. What all of them and the candidates give is looked over once, by windows, so that no
        variant's plan is there twice."""
        kind, groups = self.type_of(shape), any(not isinstance(x, Record | List | Resource | Literal) for x in shape.variants)
        no_caps = [F.lit(None).cast(TERM).alias(c) for c in self.caps]
        none = F.lit(None).cast(kind).alias("value")
        last = F.lit(len(shape.variants)).cast("long")
        rows = cands.select("ctx", F.concat(F.array(last), "ord").alias("ord"), "term", F.lit(-1).alias("variant"), F.lit(False).alias("ok"), none, F.lit(False).alias("fatal"), F.lit(None).cast(ERR).alias("err"), *no_caps)
        for i, v in enumerate(shape.variants):
            found = self.outcomes(v, cands, False)
            own = self.own_caps(shape, F.col("term")) if shape.id in self.captures else []
            rows = rows.unionByName(found.select(
                "ctx", F.concat(F.array(F.lit(i).cast("long")), "ord").alias("ord"), "term", F.lit(i).alias("variant"), "ok", self.widened(v, F.col("value"), kind).alias("value"), "fatal", "err",
                *(F.coalesce(c, own[j]).alias(c) if own else F.col(c) for j, c in enumerate(self.caps)),
            ))
        by_term, by_ctx = Window.partitionBy("ctx", "term"), Window.partitionBy("ctx")
        matched = F.bool_or("ok").over(by_term)
        why = F.first(F.when(F.col("variant") == 0, F.col("err")), ignorenulls=True).over(by_term) if self.errors else None
        rows = rows.withColumn("matched", matched)
        if self.errors:
            rows = rows.withColumn("why", why)
        if groups:  # a set or map that fits takes all candidates of its context
            rows = rows.withColumn("matched", F.col("matched") | F.bool_or(F.col("ok") & F.col("term").isNull()).over(by_ctx))
            if self.errors:
                whole = F.first(F.when((F.col("variant") == 0) & F.col("term").isNull(), F.col("err")), ignorenulls=True).over(by_ctx)
                rows = rows.withColumn("why", F.coalesce("why", whole))
        left = (F.col("variant") == -1) & ~F.col("matched")
        kept = rows.where(F.col("ok") | left | F.col("fatal"))
        err = F.when(left & F.lit(self.errors), self.under(F.col("why"), _frame_col(shape))).when(F.col("fatal"), self.under(F.col("err"), _frame_col(shape))) if self.errors else F.lit(None).cast(ERR)
        return kept.select("ctx", "ord", "term", "ok", "value", (F.col("fatal") | (left & F.lit(required))).alias("fatal"), err.alias("err"), *self.caps)

    def _gather(self, found: DataFrame) -> DataFrame:
        pair = F.when(F.col("ok"), F.struct("ord", F.col("value").alias("x"), *self.caps))
        return found.groupBy("ctx").agg(*self.gathered(found, ["ctx"]), F.min("ord").alias("ord"), F.collect_list(pair).alias("items"))

    def _group(self, shape: Shape, got: DataFrame, code: Column, value: Column, required: bool) -> DataFrame:
        """The outcome of a set or a map from what was gathered; ``code`` is 0 where the gathered items make one."""
        ok = (F.col("n_bad") == 0) & (code == 0)
        err = F.coalesce(self.under(F.col("err"), _frame_col(shape)), self.err(code, F.array(_frame_col(shape)))) if self.errors else F.lit(None).cast(ERR)
        return got.select(
            "ctx", "ord", F.lit(None).cast(TERM).alias("term"), ok.alias("ok"), F.when(ok, value).alias("value"),
            (F.col("fatal") | (F.lit(required) & ~ok)).alias("fatal"), err.alias("err"), *self.caps,
        )

    def _set(self, shape: Set, cands: DataFrame, required: bool) -> DataFrame:
        got = self._gather(self.outcomes(shape.item, cands, required))
        if shape.item.lenient:  # contexts whose candidates were all left out have an empty set
            empty = cands.groupBy("ctx").agg(F.min("ord").alias("first"))
            got = empty.join(got, "ctx", "left").withColumn("ord", F.coalesce("ord", "first")).drop("first")
            got = got.fillna({"n_ok": 0, "n_bad": 0}).withColumn("fatal", F.coalesce("fatal", F.lit(False))).withColumn("items", F.coalesce("items", F.array().cast(dict(got.dtypes)["items"])))
        n = F.col("n_ok")
        code = F.when(n < (shape.min_count or 0), 219).when(n > (shape.max_count if shape.max_count is not None else 1 << 60), 220).otherwise(0)
        values = F.transform(self._sorted(F.col("items")), lambda x: x["x"])
        return self._group(shape, got, F.when(F.col("n_bad") > 0, 0).otherwise(code), values, required)

    @staticmethod
    def _sorted(items: Column) -> Column:
        """By ord alone: values may be of types that have no order."""
        return F.array_sort(items, lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))

    def _optional(self, shape: Optional, cands: DataFrame, required: bool) -> DataFrame:
        found = self.outcomes(shape.item, cands, required)
        if self.errors:
            found = found.withColumn("err", self.under(F.col("err"), _frame_col(shape)))
        kind = self.type_of(shape)
        nulls = [F.lit(None).cast(TERM).alias(c) for c in self.caps]
        instead = found.where(~F.col("ok")).select("ctx", F.concat("ord", F.array(F.lit(1).cast("long"))).alias("ord"), F.lit(None).cast(TERM).alias("term"), F.lit(True).alias("ok"), F.lit(None).cast(kind).alias("value"), F.lit(False).alias("fatal"), F.lit(None).cast(ERR).alias("err"), *nulls)
        out = found.unionByName(instead)
        if shape.item.lenient:
            lost = cands.select("ctx", "ord").join(found.select("ctx").distinct(), "ctx", "left_anti").groupBy("ctx").agg(F.min("ord").alias("ord"))
            out = out.unionByName(lost.select("ctx", "ord", F.lit(None).cast(TERM).alias("term"), F.lit(True).alias("ok"), F.lit(None).cast(kind).alias("value"), F.lit(False).alias("fatal"), F.lit(None).cast(ERR).alias("err"), *nulls))
        return out

    def _map(self, shape: Map, cands: DataFrame, required: bool) -> DataFrame:
        found = self.outcomes(shape.item, cands, required)
        got = self._gather(found)
        key_col = lambda x: self.referred(shape.key, x)
        missing = F.exists("items", lambda x: x[self.cap(shape.key.target)].isNull())
        code = F.when(missing, 217)
        if shape.value:
            code = code.when(F.exists("items", lambda x: x[self.cap(shape.value.target)].isNull()), 218)
        value = (lambda x: self.referred(shape.value, x)) if shape.value else (lambda x: x["x"])
        entries = F.transform(self._sorted(F.col("items")), lambda x: F.struct(self.key_text(shape.key, key_col(x)).alias("key"), value(x).alias("value")))
        # Of equal keys the last wins, in the place of the last.
        ordered = F.aggregate(entries, F.create_map().cast(self.type_of(shape)), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
        return self._group(shape, got, F.when(F.col("n_bad") > 0, 0).otherwise(F.coalesce(code, F.lit(0))), ordered, required)

    def key_text(self, ref: Reference, c: Column) -> Column:
        kind = self.reference_type(ref)
        if isinstance(kind, T.StructType):
            raise ShapeError(212, detail="the key refers to a term")
        text = c.cast("string")
        return F.regexp_replace(text, r"\.0$", "") if isinstance(kind, T.DoubleType) else text

    def referred(self, ref: Reference, row) -> Column:
        t, target = row[self.cap(ref.target)], self.shapes[ref.target]
        if ref.part:
            if not isinstance(target, Resource | Literal):
                raise ShapeError(213, detail=f"part {ref.part!r} of a {target.kind}")
            return {"value": t["value"], "language": t["lang"]}.get(ref.part) if ref.part != "datatype" else F.struct(F.lit(0).cast("tinyint").alias("kind"), t["datatype"].alias("value"), F.lit("").alias("datatype"), F.lit("").alias("lang"))
        return self.codec.decode(target, t) if isinstance(target, Resource | Literal) else t

    def codec_synthesise(self, shape: Shape, seen: dict[str, Column]) -> Column:
        """A value from constants and captures."""
        if isinstance(shape, Record):
            return F.struct(*(self.codec_synthesise(p.shape, seen).alias(p.name) for p in shape.all_properties()), *(self.codec_synthesise(s, seen).alias(n) for n, s in shape.computed))
        if isinstance(shape, Set):
            n = min((c for c in (shape.min_count, shape.max_count) if c is not None), default=0)
            return F.array_repeat(self.codec_synthesise(shape.item, seen), n)
        if isinstance(shape, Optional | List | Map):
            empty = F.lit(None) if isinstance(shape, Optional) else F.array() if isinstance(shape, List) else F.create_map()
            return empty.cast(self.type_of(shape))
        if isinstance(shape, AnyOf):
            raise ShapeError(301, [{"shape": shown(shape)}])
        if shape.value is not None:
            return self.codec.decode(shape, constant_col(shape.value))
        code = 305 if isinstance(shape, Resource) else 306
        missing = F.raise_error(F.lit(f"{code} nothing to synthesise {shown(shape)} from")).cast(self.type_of(shape))
        return F.when(seen[shape.id].isNull(), missing).otherwise(self.codec.decode(shape, seen[shape.id]))

    # -- lists -----------------------------------------------------------------------------------------------------------

    def _list(self, shape: List, cands: DataFrame, required: bool) -> DataFrame:
        return self._per_term(cands, self.lists(shape, cands.select("term").distinct(), required))

    def _walk(self, shape: List, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(head, pos, node) for every cell of every list, by pointer doubling, and (node, n_rest, rest) of every cell."""
        nil = constant_col(shape.nil)
        # Cells that tails lead to, starting from the heads, each once.
        cells = follow(self.quads, starts(heads), Path("zeroOrMore", parts=(shape.tail,))).select("term").distinct()
        cells = checkpointed(cells.where(~same_term(F.col("term"), nil) & is_resource(F.col("term"))))
        rest = follow(self.quads, starts(cells), shape.tail).groupBy("ctx").agg(F.size(F.collect_set("term")).alias("n_rest"), F.min("term").alias("rest"))
        links = checkpointed(cells.join(rest, same_term(F.col("term"), F.col("ctx")), "left").select(F.col("term").alias("node"), F.coalesce("n_rest", F.lit(0)).alias("n_rest"), "rest"))
        jump = links.where("n_rest = 1").select(F.col("node").alias("a"), F.col("rest").alias("b"))
        rows = checkpointed(heads.select(F.col("term").alias("head"), F.lit(0).cast("long").alias("pos"), F.col("term").alias("node")))
        most, step = cells.count() + 1, 1
        while step <= most:
            on = same_term(F.col("node"), F.col("a"))
            more = checkpointed(rows.join(jump, on).select("head", (F.col("pos") + step).alias("pos"), F.col("b").alias("node")))
            if more.isEmpty():
                break
            rows = rows.unionByName(more)  # of what was written, one part a round
            j1, j2 = jump.alias("j1"), jump.alias("j2")
            jump = checkpointed(j1.join(j2, same_term(F.col("j1.b"), F.col("j2.a"))).select(F.col("j1.a").alias("a"), F.col("j2.b").alias("b")))
            step *= 2
        return rows, links

    def lists(self, shape: List, heads: DataFrame, required: bool) -> DataFrame:
        rows, links = self._walk(shape, heads)
        nil = constant_col(shape.nil)
        at = rows.where(~same_term(F.col("node"), nil) & is_resource(F.col("node")))
        nodes = at.select(F.col("node").alias("term")).distinct()
        heads_of = follow(self.quads, starts(nodes), shape.head).groupBy("ctx").agg(F.size(F.collect_set("term")).alias("n_head"), F.min("term").alias("term"))
        one = heads_of.where("n_head = 1").select("ctx", F.array(F.lit(0).cast("long")).alias("ord"), "term")
        found = self.outcomes(shape.item, one, required)
        value = F.max_by(F.when(F.col("ok"), F.struct(F.col("value").alias("x"))), F.when(F.col("ok"), F.col("ord")))["x"]
        items = found.groupBy("ctx").agg(*self.gathered(found, ["ctx"]), value.alias("x"))
        cell = (
            links.join(heads_of.select(F.col("ctx").alias("h"), "n_head"), same_term(F.col("node"), F.col("h")), "left")
            .join(items, same_term(F.col("node"), F.col("ctx")), "left").drop("h", "ctx")
        )
        if (s := self.static(shape.item)).matches:  # an item shape that matches nothing at all, such as a set
            cell = cell.withColumn("x", F.when(F.col("n_ok").isNull() & (F.col("n_head") == 1), s.matches[0]).otherwise(F.col("x"))).withColumn("n_ok", F.when(F.col("n_ok").isNull() & (F.col("n_head") == 1), F.lit(len(s.matches)).cast("long")).otherwise(F.col("n_ok")))
        n_head, n_ok, n_bad = F.coalesce("n_head", F.lit(0)), F.coalesce("n_ok", F.lit(0)), F.coalesce("n_bad", F.lit(0))
        code = (
            F.when(n_head == 0, 207).when(n_head > 1, 206).when(n_bad > 0, -1).when(n_ok == 0, 209).when(n_ok > 1, 208)
            .when(F.col("n_rest") == 0, 211).when(F.col("n_rest") > 1, 210).otherwise(0)
        )
        cell = cell.withColumn("code", code).withColumnRenamed("node", "c")
        joined = at.join(cell, same_term(F.col("node"), F.col("c")))
        repeated = joined.groupBy("head", "node").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("head").distinct()
        per = joined.groupBy("head").agg(
            F.min(F.when(F.col("code") != 0, F.struct("pos", "code", "err"))).alias("first"), F.collect_list(F.struct("pos", "x")).alias("cells"),
            F.coalesce(F.bool_or("fatal"), F.lit(False)).alias("fatal"), *(F.max(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("t"))))["t"].alias(c) for c in self.caps),
        )
        ends = rows.where(~is_resource(F.col("node"))).select(F.col("head").alias("literal_end")).distinct()
        looped = repeated.select(F.col("head").alias("looped"))
        out = heads.join(per, same_term(F.col("term"), F.col("head")), "left").join(ends, same_term(F.col("term"), F.col("literal_end")), "left").join(looped, same_term(F.col("term"), F.col("looped")), "left")
        code = F.when(F.col("looped").isNotNull(), 903).when(F.col("first").isNotNull(), F.col("first.code")).when(F.col("literal_end").isNotNull(), 205).otherwise(0)
        ok = code == 0
        values = F.transform(F.array_sort(F.coalesce("cells", F.array().cast(dict(per.dtypes)["cells"])), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)), lambda c: c["x"])
        me = _frame_col(shape, term_text_col(F.col("term")))
        err = F.when(code == -1, self.under(F.col("first.err"), _frame_col(shape))).otherwise(self.err(code, F.array(me))) if self.errors else F.lit(None).cast(ERR)
        return out.select("term", ok.alias("ok"), F.when(ok, values).alias("value"), (F.coalesce("fatal", F.lit(False)) | (F.lit(required) & ~ok)).alias("fatal"), err.alias("err"), *self.caps)


@dataclass
class Framed:
    """values: (ord, value). errors: (term, code, stack), for mode "permissive"."""

    values: DataFrame
    errors: DataFrame | None = None


def _reads_twice(shape: Shape) -> bool:
    """Whether the shape's plan has its candidates in it more than once."""
    if isinstance(shape, Resource | Literal):
        return False
    return shape.item.lenient or _reads_twice(shape.item) if isinstance(shape, Set | Optional) else True


def _is_flat(shape: Shape) -> bool:
    """Whether one pass over the quads is all that framing takes."""
    if not isinstance(shape, Record):
        return isinstance(shape, Resource | Literal)
    return all(p.path.kind == "predicate" and isinstance(p.shape, Resource | Literal) and not p.shape.lenient for p in shape.all_properties())


def frame_outcomes(quads: DataFrame, shape: Shape, candidates: DataFrame | None, strict: bool, codec: ValueCodec, errors: bool, stage: bool = True) -> DataFrame:
    c = Compiler(quads, codec, errors, captured_ids(shape))
    c.shapes = reachable(shape)
    if stage and not _is_flat(shape):
        c.quads = staged(quads, all_predicates(shape))
    if isinstance(shape, Record) and candidates is None:
        if shape.lenient or not strict:
            out = c.records(shape, None, False)
        else:
            out = c.records(shape, None, True)
        return out.select(F.col("term").alias("root"), F.array("ord").alias("ord"), "ok", "value", "fatal", "err")
    if candidates is None:
        at = quads.select((F.col("ord") * 2).alias("ord"), F.col("s").alias("term")).unionByName(quads.select((F.col("ord") * 2 + 1).alias("ord"), F.col("o").alias("term")))
        candidates = at.groupBy("term").agg(F.min("ord").alias("ord"))
    if "ord" not in candidates.columns:
        candidates = candidates.withColumn("ord", F.monotonically_increasing_id())
    nowhere = F.struct(F.lit(LITERAL + 1).cast("tinyint").alias("kind"), F.lit("").alias("value"), F.lit("").alias("datatype"), F.lit("").alias("lang"))
    found = c.outcomes(shape, candidates.select(nowhere.alias("ctx"), F.array("ord").alias("ord"), "term"), strict)
    return found.select(F.col("term").alias("root"), "ord", "ok", "value", "fatal", "err")


def frame(
    quads: DataFrame, shape: Shape, candidates: DataFrame | None = None, strict: bool | None = None, codec: ValueCodec | None = None, mode: str = "failfast",
    stage: bool = True,
) -> Framed:
    """Every value of ``shape`` in the graph, or in ``candidates`` (a column ``term``) with errors for those that don't fit.

    ``strict`` (default: whether candidates are given) makes roots that do not fit an error; otherwise they are left out, and only
    what type properties have promised is an error. Recursive shapes give their values as JSON text (see ``frame_recursive``).
    """
    strict = candidates is not None if strict is None else strict
    if is_recursive(shape):
        return Framed(frame_recursive(quads, shape, candidates, strict))
    out = frame_outcomes(quads, shape, candidates, strict, codec or default_codec(), mode != "drop", stage)
    values = out.where("ok and not fatal").select("root", "ord", "value")
    if mode == "drop":
        return Framed(values)
    errors = out.where("fatal").select("ord", F.col("root").alias("term"), F.col("err.code").alias("code"), F.col("err.stack").alias("stack"))
    if mode == "failfast":
        first = errors.orderBy("ord").limit(1).collect()
        if first:
            raise ShapeError(first[0]["code"] or 201, [{k: v for k, v in x.asDict().items() if v is not None} for x in first[0]["stack"] or []])
        return Framed(values)
    return Framed(values, errors)


def fields(framed: Framed | DataFrame) -> DataFrame:
    """A framed record's fields as columns."""
    return (framed.values if isinstance(framed, Framed) else framed).select("value.*")


def all_predicates(shape: Shape) -> list[str]:
    out: dict[str, None] = {}

    def of(p: Path) -> None:
        if p.kind == "predicate":
            out[p.iri] = None
        for x in p.parts:
            of(x)

    for s in reachable(shape).values():
        if isinstance(s, Record):
            for p in s.all_properties():
                of(p.path)
        if isinstance(s, List):
            of(s.head)
            of(s.tail)
    return list(out)


def frame_recursive(quads: DataFrame, shape: Shape, candidates: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(root, ord, value): values of a recursive shape as JSON, records that refer to each other as ``@ref`` and ``@use``.

    A value can be as large as what its root reaches; that part of the graph, by the shape's predicates in either direction they are
    used in, is gathered per root, and each root's value is built where its part is.
    """
    preds = all_predicates(shape)
    used = quads.where(F.col("p").isin(preds))
    first = next((p.path.iri for p in shape.type_properties if p.path.kind == "predicate"), None) if isinstance(shape, Record) else None
    if candidates is None:
        source = used.where(F.col("p") == first) if first else used
        candidates = source.select(F.col("s").alias("term"), "ord").groupBy("term").agg(F.min("ord").alias("ord"))
    elif "ord" not in candidates.columns:
        candidates = candidates.withColumn("ord", F.monotonically_increasing_id())
    steps = tuple(Path("predicate", p) for p in preds)
    back = tuple(Path("inverse", parts=(s,)) for s in steps) if _goes_back(shape) else ()
    part = follow(used, starts(candidates.select("term")), Path("zeroOrMore", parts=(Path("alternative", parts=steps + back),)))
    on = same_term(F.col("s"), F.col("node"))
    local = part.select(F.col("ctx").alias("root"), F.col("term").alias("node")).join(used, on).select("root", F.struct("ord", "s", "p", "o", "g").alias("quad"))
    # A root that has no quads of its own still has a value if the shape matches nothing.
    local = local.unionByName(candidates.select(F.col("term").alias("root"), F.lit(None).cast(dict(local.dtypes)["quad"]).alias("quad")))

    def build(part: pa.Table) -> pa.Table:
        r = json.loads(part.column("root")[0].as_py())
        rows = sorted((json.loads(q) for q in part.column("quad").to_pylist() if q is not None), key=lambda q: q["ord"])
        graph = Graph(Quad(Term(**q["s"]), q["p"], Term(**q["o"]), Term(**q["g"])) for q in rows)
        root = Term(*(r[k] for k in ("kind", "value", "datatype", "lang")))
        found = Framer(graph).frame(shape, [root], strict)
        made = [json.dumps(as_json(v), ensure_ascii=False) for v in found]
        return pa.table({"root_text": pa.array([str(root)] * len(made), pa.string()), "n": pa.array(range(len(made)), pa.int32()), "value": pa.array(made, pa.string())})

    keyed = local.select(term_text_col(F.col("root")).alias("key"), F.to_json("root").alias("root"), F.to_json("quad").alias("quad"))
    made = keyed.groupBy("key").applyInArrow(build, "root_text string, n int, value string")
    roots = candidates.select("term", F.array("ord").alias("ord"), term_text_col(F.col("term")).alias("root_text"))
    return made.join(roots, "root_text").select(F.col("term").alias("root"), F.concat("ord", F.array(F.col("n").cast("long"))).alias("ord"), "value")


def _goes_back(shape: Shape) -> bool:
    def has(p: Path) -> bool:
        return p.kind == "inverse" or any(has(x) for x in p.parts)

    return any(has(p.path) for s in reachable(shape).values() if isinstance(s, Record) for p in s.all_properties()) or any(has(s.head) or has(s.tail) for s in reachable(shape).values() if isinstance(s, List))


__all__ = ["SELF", "Compiler", "Framed", "all_predicates", "fields", "frame", "frame_outcomes", "frame_recursive"]
