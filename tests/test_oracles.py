"""Every engine query against its SQL on the smallest sample tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ionweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def ordered(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = ordered(registry.QUERIES[name](spark, DATA).toPandas()), ordered(duck.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), f"{c}: {got[c][~same].iloc[0]!r} and {want[c][~same].iloc[0]!r}"


@pytest.mark.parametrize("name", ["overlap_table", "specificity_quantify", "legacy_quantify", "normalize_rms", "annotate_ppm", "nearest_projection", "register_rank_zip", "braycurtis_pairs", "rank_wilcoxon"])
def test_plans_have_no_nested_loop_over_tables(spark, name):
    """Only single-row or per-group tables may be nested-loop joined, and those are broadcast."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name in ("annotate_ppm", "nearest_projection", "register_rank_zip", "braycurtis_pairs", "normalize_rms", "legacy_quantify"):
        loops = plan.count("BroadcastNestedLoopJoin")
        assert loops <= (1 if name == "legacy_quantify" else 0)


def test_scans_read_the_needed_columns_only(spark):
    plan = registry.QUERIES["normalize_tic"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schemas = {line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line}
    assert schemas and all(s.count(":") == 3 for s in schemas), schemas


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = registry.QUERIES["exclude_regions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: ")[1].splitlines()[0]
    assert "GreaterThanOrEqual(s_acctbal,0.0)" in pushed and "LessThanOrEqual(s_acctbal,5000.0)" in pushed
