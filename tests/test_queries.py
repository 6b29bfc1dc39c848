"""Every core query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from tools.compare import norm
from tracewright.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = con.execute(registry.ORACLE[name])
    have = [c[0] for c in r.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    theirs = sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE) <= set(registry.QUERIES)
