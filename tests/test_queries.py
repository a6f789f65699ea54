"""Every registered query against its SQL on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from satchel import queries as Q


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        value = value.date()
    return str(value)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, sf_dir, tables, name):
    got = Q.QUERIES[name](spark, sf_dir)
    want = tables.sql(Q.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in data) for names, data in ((got.columns, got.collect()), (want.columns, want.fetchall()))]
    assert rows[0] == rows[1]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = Q.QUERIES["jobs_list_status"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderstatus,F)" in plan.split("PushedFilters: [")[1].split("]")[0]
    plan = Q.QUERIES["job_progress"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "BatchEvalPython" not in plan
