"""Every query that has SQL against DuckDB on the smallest test data."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path("/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items()}
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in ROOT.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(ROOT))
    cur = duck.execute(SQL[name])
    kinds = {c[0]: TYPES[str(c[1])] for c in cur.description}
    columns = sorted(df.columns)
    assert kinds == dict(df.dtypes)
    order = [c[0] for c in cur.description]
    want = Counter(tuple(row[order.index(c)] for c in columns) for row in cur.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_every_query_gives_a_stable_schema(spark):
    queries = entry.queries()
    assert len(queries) > 50 and set(SQL) <= set(queries)
    assert entry.entry(spark).schema == entry.entry(spark).schema
