"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from conftest import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLE:
        problem, rows = compare(name, df, ORACLE[name], connection)
        assert problem == "" and rows > 0
    else:
        assert df.count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows == sorted(rows, key=lambda r: (-r["avg_price"], r["nation"]))
