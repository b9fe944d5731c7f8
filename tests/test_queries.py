import pytest
from conftest import same_rows

from quillon.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    QUERIES[name](spark, data).count()


def test_entry(spark, data):
    assert catalog.flagship(spark, data).count() > 0
