"""The registered queries: names, and those with SQL against it on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from rubrica.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(queries.queries()) <= set(entry.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    problem, rows, _ = oracle.compare(spark, oracle.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None and rows
