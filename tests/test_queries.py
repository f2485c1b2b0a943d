import pytest
from compare import duck, expected, rows
from conftest import SF

from doseframe import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows(registry.queries()[name](spark, SF)) == expected(duck(SF), SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
