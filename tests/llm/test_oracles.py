"""Queries with SQL give the rows that DuckDB gives over whole tables."""

import os

import duckdb
import pytest

from claimspark.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
