"""Contracts with SQL give the rows that DuckDB gives."""

import pytest

from helixframe.llm import registry
from tests.compare import database, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, name):
    assert differences(spark, database(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""
