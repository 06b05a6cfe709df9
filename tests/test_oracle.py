"""Every registered query that has SQL, against DuckDB over the same tables."""

import pytest

from tidemark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, same, data_dir, name):
    same(catalogue.QUERIES[name](spark, data_dir).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 90
