"""Every query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hawser import queries as core
from hawser import queries_more  # noqa: F401  (adds to core)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    got = core.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(norm, r)) for r in got.select(*cols).collect())
    if name not in core.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).columns and set(core.queries()) <= set(entry.queries())
