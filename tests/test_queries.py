"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as driver
from workload.check import connect, differences
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_and_scales(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert differences(duck, df, ORACLE[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in (
        "CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "SinglePartition",
    ):
        assert unwanted not in plan


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= driver.queries().keys()


def test_entry(spark):
    assert driver.entry(spark).count() > 0
