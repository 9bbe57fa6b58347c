"""Every catalogue query against its SQL."""

import pytest

from gridloom.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, same_rows):
    same_rows(catalog.queries()[name], catalog.oracle_sql()[name])


def test_queries_without_sql_have_rows(spark, sf):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, sf).count() > 0, name


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["idx", "val"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
