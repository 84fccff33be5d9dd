"""Every query with SQL against DuckDB; the others must run and give rows of a stable schema."""

import pytest
from conftest import SMALL, duck, normal
from verbena.plans import evaluation, files, integrity, judging, reports, schema_drift, spatial, streams, texts

MODULES = (evaluation, reports, judging, texts, spatial, files, streams, integrity, schema_drift)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["pricing_summary"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan or "LessThan" in plan
    scan = next(x for x in plan.split("\n") if "FileScan" in x or "Scan parquet" in x)
    assert "l_comment" not in scan and "l_partkey" not in scan
