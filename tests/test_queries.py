from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from cairn.plans import evidence_queries, problem_queries
from tests.oracle import TABLES, connection, rows_of_frame, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
CORE = evidence_queries.QUERIES | problem_queries.QUERIES
SQL = evidence_queries.SQL | problem_queries.SQL


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", list(CORE))
def test_query_equals_its_sql(spark, con, name):
    got = rows_of_frame(CORE[name](spark, TABLES))
    if name in SQL:
        assert got == rows_of_sql(con, SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["table_name", "endpoint", "period", "orphans"] and df.count() > 0


def test_all_are_registered():
    assert set(CORE) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
