"""Every registered catalog query against its SQL."""

import pytest

from medialake import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name, plans.QUERIES[name], plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_gives_rows(name, spark):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
