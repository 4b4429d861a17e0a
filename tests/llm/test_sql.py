"""Queries whose results SQL can state, compared whole at the smallest scale."""

import pytest

from tests.llm.conftest import same_rows
from tidewright.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    assert same_rows(QUERIES[name](spark, small), con.execute(SQL[name])) > 0


def test_each_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)}
