import pytest
from compare import both

from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, sf, name):
    assert both(spark, sf, name, catalog.QUERIES[name], catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
