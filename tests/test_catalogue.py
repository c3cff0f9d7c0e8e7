"""Each catalogue query against its SQL at the smallest scale, and the plans of a few."""

import pytest
from oracle import connect, same

import __spark_entry__
from tracewright.plans import catalogue, evidence, evidence_sql, sql  # noqa: F401 (evidence adds to both)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_matches_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(sql.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_needed_columns_only(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string" in plan(catalogue.nx_rate(spark, SF)).replace("ts:timestamp_ntz,", "")


def test_no_products_in_hot_joins(spark):
    for name in ("asof_parent", "event_attach_fallback", "alert_band_tag", "cidr_enrich", "shared_ioc"):
        assert "CartesianProduct" not in plan(catalogue.QUERIES[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in plan(catalogue.QUERIES[name](spark, SF))
