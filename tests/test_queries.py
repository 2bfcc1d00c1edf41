"""Every registered query against DuckDB at the smallest scale; those without SQL must return rows of a stable schema."""

import oracle
import pytest

from barline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def con():
    """A connection of its own for each query, so that a fault of one shows as that query's."""
    with oracle.database(SF) as own:
        yield own


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql:
        oracle.compare(spark, con, registry.queries()[name], sql, SF)
    else:
        assert registry.queries()[name](spark, SF).schema == registry.queries()[name](spark, SF).schema


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
