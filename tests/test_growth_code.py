"""Index queries parse a source file once, however many tables they ask for."""

import pytest

from repolens.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parse_symbols", "index_references", "index_usages", "index_metadata"])
def test_tables_read_what_was_parsed(spark, name):
    found = registry.queries()[name](spark, SMALL)
    plan = found._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()
