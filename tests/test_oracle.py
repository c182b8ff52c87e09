"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from helixframe import registry
from tests.compare import database, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, db, name):
    assert differences(spark, db, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""
