"""Every named query against its SQL, and the plans they run with."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from cordwood.plans.catalogue import QUERIES
from cordwood.plans.oracles import SQL
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def duck(tables):
    return connect(tables)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(SQL) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result_as_sql(spark, tables, duck, name):
    frame = QUERIES[name](spark, tables).toPandas()
    assert differences(frame, duck.sql(SQL[name]).df()) == []
    assert len(frame) > 0


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, tables, name):
    text = plan(QUERIES[name](spark, tables))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert operator not in text


def test_time_range_reaches_the_scan(spark, tables):
    text = plan(QUERIES["search_time_range"](spark, tables))
    assert "GreaterThanOrEqual(ts," in text and "LessThanOrEqual(ts," in text


def test_pages_use_top_k(spark, tables):
    for name in ("search_page1", "search_page2", "search_all_filters"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, tables))


def test_narrow_scans(spark, tables):
    text = plan(QUERIES["services"](spark, tables))
    assert "ReadSchema: struct<user_id:bigint>" in text
