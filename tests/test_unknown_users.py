"""Registered lookups of users whom the tables don't know: a user without entries, as in their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tools.compare import norm
from tracewright.operators import lookup, typed
from tracewright.plans import registry
from tracewright.plans.spec import LookupSpec
from tracewright.sources import store as st
from tracewright.sources.fixtures import NOW

#: Queries that ask for users by name.
QUERIES = ["api_perform_lookup", "lookup_chat", "lookup_inventory_plus", "rollback_state_toggle_inventory", "api_perform_partial_lookup", "lookup_inventory", "lookup_username", "lookup_block_user_time", "lookup_inventory_minus", "rollback_inventory_net"]


@pytest.fixture(scope="module", params=["none", "some"])
def folder(request, spark, sf, tmp_path_factory):
    """The tables with other names for all users, or for all but the one that most queries ask for."""
    d = tmp_path_factory.mktemp(request.param)
    for f in os.listdir(sf):
        if f != "dim_user.parquet":
            os.symlink(f"{sf}/{f}", d / f)
    known = F.lower("name") == ("quarrel_finch" if request.param == "some" else "")
    renamed = F.when(known | F.col("name").startswith("#"), F.col("name")).otherwise(F.concat("name", F.lit("_2")))
    spark.read.parquet(f"{sf}/dim_user.parquet").withColumn("name", renamed).coalesce(1).write.parquet(str(d / "dim_user.parquet"))
    return request.param, str(d)


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder[1]):
        path = f"{folder[1]}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, folder, con, tmp_path, name):
    known, d = folder
    registry.QUERIES[name](spark, d).write.parquet(str(tmp_path / "out"))
    df = spark.read.parquet(str(tmp_path / "out"))
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE[name])
    have = [c[0] for c in r.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    theirs = sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert bool(theirs) == (known == "some")
    assert sorted((tuple(norm(v) for v in row) for row in df.select(*cols).collect()), key=repr) == theirs


def test_unknown_users_are_not_all_users(spark, sf):
    s = st.LogStore.given(spark, sf)
    count = lambda *users: typed.perform_lookup(s, NOW, 14 * 86_400, users=users).count()
    assert count("nobody-of-that-name") == 0 and count("nobody-of-that-name", "nor-of-this") == 0
    assert count("nobody-of-that-name", "quarrel_finch") == count("Quarrel_Finch") > 0
    for action in (0, 4, 6, 7, 8, 9, 10, 11):
        assert lookup.rows(s, LookupSpec((action,), users=("nobody-of-that-name",), unknown_users=True)).count() == 0
    excluding = LookupSpec((0,), users=("nobody-of-that-name",), exclude_users=("quarrel_finch",), unknown_users=True)
    assert lookup.rows(s, excluding).count() == 0
