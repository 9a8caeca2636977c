"""Every registered query that SQL can express, against DuckDB on the same tables; the others return rows."""

import os

import duckdb
import pytest

from tidewright.plans import registry

#: Panels need more sessions that all 18 symbols have than the smallest tables hold.
LARGER = "/root/testdata/sf0.01"
DATA = os.environ.get("TWIN_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def cons():
    found = {}
    for d in {DATA, LARGER}:
        found[d] = duckdb.connect()
        for t in TABLES:
            found[d].execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return found


def shown(rows, near=False):
    whole = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr(tuple(map(whole, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, cons, name):
    data = LARGER if name.startswith(("D4", "X7", "X8", "D15", "M23_network")) else DATA
    con, df = cons[data], registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in registry.SQL:
        assert found
        return
    twin = con.sql(registry.SQL[name])
    assert columns == sorted(twin.columns)
    kinds = dict(zip(twin.columns, map(str, twin.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    at = [twin.columns.index(c) for c in columns]
    assert shown(found) == shown(tuple(r[i] for i in at) for r in twin.fetchall())


def test_entry_without_a_session_lists_everything():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
