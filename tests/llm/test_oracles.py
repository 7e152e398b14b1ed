"""Training-data queries that SQL can express, on the smallest sample tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ionweave.llm import registry

from ..test_oracles import DATA, ordered

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = ordered(registry.QUERIES[name](spark, DATA).toPandas()), ordered(con.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want.astype(got.dtypes.to_dict()))
