"""Every registered query against its SQL, on whole tables, and what its plan may not hold."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare

import __spark_entry__ as contract
from runledger.catalog import REGISTRY
from runledger.catalog.base import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    got = compare.rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == compare.rows_of(columns, result.fetchall())


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).columns == ["path", "step", "dep"]
