"""Every registered query against its SQL on the smallest tables."""

import pytest

from tidemark import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, same, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        same(got, duck(sf, catalog.ORACLES[name]))
    else:
        assert len(got)


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["id", "timestamp"]
