"""Every registered query gives the rows its SQL gives."""

import pytest

from check_queries import compare, connect


def names():
    from tracewarden.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_matches_its_sql(spark, folder, name):
    from __spark_entry__ import oracle_sql, queries

    found = compare(spark, connect(folder), folder, name, queries()[name], oracle_sql().get(name))
    assert found.startswith("ok"), found


def test_queries_have_sql_and_sql_has_queries():
    from __spark_entry__ import oracle_sql, queries

    assert set(names()) <= set(oracle_sql()) <= set(queries())


def test_flagship_keeps_its_schema(spark):
    from __spark_entry__ import entry

    found = entry(spark)
    assert found.columns == ["key", "session_start", "session_end", "propertyName", "truthValue"]
    assert not found.isEmpty()
