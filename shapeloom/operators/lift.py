"""Tables as quads: a subject per row and a quad per column that is not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import XSD_BOOLEAN, XSD_DATETIME, XSD_DOUBLE, XSD_INTEGER, XSD_STRING, default_graph, iri_col, literal_col, number_text_col

_TYPES = {"tinyint": XSD_INTEGER, "smallint": XSD_INTEGER, "int": XSD_INTEGER, "bigint": XSD_INTEGER, "double": XSD_DOUBLE, "float": XSD_DOUBLE, "boolean": XSD_BOOLEAN, "timestamp": XSD_DATETIME, "timestamp_ntz": XSD_DATETIME}


def lift(table: DataFrame, subject: Column, properties: dict[str, str | Column], type_iri: str | None = None) -> DataFrame:
    """``properties``: predicate -> a column's name (a literal of its type) or a column of terms.

    All of a row's quads are made in one pass over the table; the order of quads is that of rows' keys, by a hash of the subject.
    """
    types = dict(table.dtypes)
    pairs = []
    if type_iri:
        pairs.append(("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", iri_col(type_iri), F.lit(True)))
    for p, c in properties.items():
        if isinstance(c, str):
            text = number_text_col(F.col(c)) if types[c] in ("double", "float") else F.col(c).cast("string")
            pairs.append((p, literal_col(text, _TYPES.get(types[c], XSD_STRING)), F.col(c).isNotNull()))
        else:
            pairs.append((p, c, c["value"].isNotNull()))
    made = F.array(*(F.when(there, F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), o.alias("o"))) for i, (p, o, there) in enumerate(pairs)))
    rows = table.select(subject.alias("s"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("q"))
    order = F.shiftleft(F.pmod(F.xxhash64("s"), F.lit(1 << 52)), 8) + F.col("q.i")
    return rows.select(order.alias("ord"), "s", F.col("q.p").alias("p"), F.col("q.o").alias("o"), default_graph().alias("g"))
