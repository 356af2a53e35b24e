"""Every registered query against its DuckDB SQL, and what no plan may contain."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect
from tripsearch import queries as registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = dict(registry.QUERIES)
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "ArrowEvalPython", "BatchEvalPython", "InPandas"):
        assert word not in plan, word
    # only measures that fill a table cell by cell step in numpy, one Arrow batch of trips at a time
    assert ("MapInArrow" in plan) == name.startswith(("edwp", "lcss", "sim_ordered", "ordered_topk", "ordered_by"))
    problem = compare(con, df, SQL[name])
    assert problem is None or problem == "empty on both sides"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0]["sim"] >= rows[-1]["sim"]


def test_single_search_is_one_scan_and_one_exchange(spark):
    df = QUERIES["kbct"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "ReadSchema: struct<trip_id:string,lng:double,lat:double>" in plan
    assert "TakeOrderedAndProject" in plan


def test_batch_limits_each_task_before_the_shuffle(spark):
    plan = QUERIES["kbct_batch"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("FileScan") == 1
