from __future__ import annotations

import os

import pytest

from cairn.llm.queries import QUERIES, SQL
from tests.oracle import TABLES, connection, rows_of_frame, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = rows_of_frame(QUERIES[name](spark, TABLES))
    if name in SQL:
        assert got == rows_of_sql(connection(), SQL[name])
    else:
        assert got[1]
