"""Every registered query beside its SQL, on whole tables."""

import pytest
from check import compare, connect

from __spark_entry__ import entry
from isopleth.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


# Plan nodes that pair every row with every row, or leave the JVM.
UNWANTED = ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups", "DeserializeToObject")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [node for node in UNWANTED if node in plan] == []
    assert compare(df, duck, SQL[name]) == []
