"""Why a part of a graph does not fit a shape: codes, and the stack of shapes that leads there."""

from __future__ import annotations

#: The codes that results are compared by.
CODES = {
    101: "MissingShape",
    201: "ShapeMismatch",
    202: "PropertyMismatch",
    203: "NoPropertyMatches",
    204: "MultiplePropertyMatches",
    205: "NonResourceTerm",
    206: "MultipleListHeadMatches",
    207: "NoListHeadMatches",
    208: "MultipleListItemMatches",
    209: "NoListItemMatches",
    210: "MultipleListTailMatches",
    211: "NoListTailMatches",
    212: "CompositeMapKey",
    213: "FailedToCompactValue",
    214: "NonMatchingStackFrame",
    215: "InconsistentStackFrame",
    216: "CyclicMatch",
    217: "NoMapKeyMatches",
    218: "NoMapValueMatches",
    219: "MinCountMismatch",
    220: "MaxCountMismatch",
    221: "TermTypeMismatch",
    222: "TermValueMismatch",
    223: "LiteralDatatypeMismatch",
    224: "LiteralLanguageMismatch",
    301: "CannotSynthesizeShapeType",
    302: "CannotSynthesizeResourceFromNonString",
    303: "CannotSynthesizeResourceFromPart",
    304: "CannotSynthesizePartFromNonString",
    305: "NoMatchesToSynthesize",
    306: "NoPartToSynthesize",
    401: "FailedToMatchProperties",
    402: "FailedToMatchProperty",
    403: "LiteralSubject",
    # Of this library only.
    901: "UnknownVocabularyTerm",
    902: "InconsistentSelfSubjects",
    903: "CyclicList",
}


class ShapeError(Exception):
    """``stack``: dicts with shape and, where there is one, edge and focus."""

    def __init__(self, code: int, stack=(), detail: str = ""):
        self.code, self.stack = code, [dict(x) for x in stack]
        where = " / ".join(".".join(str(x[k]) for k in ("edge", "shape") if x.get(k) is not None) + (f" at {x['focus']}" if x.get("focus") else "") for x in self.stack)
        super().__init__(f"{code} {CODES.get(code, 'Unknown')}" + (f": {detail}" if detail else "") + (f" in {where}" if where else ""))

    def __reduce__(self):
        return ShapeError, (self.code, self.stack)


def is_shape_error(e: BaseException) -> bool:
    return isinstance(e, ShapeError)


def shown(shape) -> str:
    """A shape's IRI, or its kind in parentheses where it has none."""
    return f"({shape.kind})" if shape.id.startswith("_:") else shape.id
