"""The driver's queries at the smallest size, against DuckDB on the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from shapeloom import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
CHOSEN = ["frame_flat_record", "frame_nested_record", "frame_inverse_set", "frame_optional", "frame_any_of", "frame_computed", "flatten_records", "query_construct", "store_mutation", "sink_ntriples"]


def rows(df):
    norm = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 4) if isinstance(x, int | float) else str(x)
    return sorted((tuple(norm(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    ours, theirs = catalog.QUERIES[name](spark, str(SF)).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df().astype(object)
    assert rows(ours.astype(object)) == rows(theirs.where(theirs.notna(), None))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
