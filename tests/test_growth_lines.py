"""Queries over order lines: the number of tasks follows the rows."""

import pytest

from repolens.plans import graph_queries, registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["cochange_pairs", "class_hierarchy"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    query = registry.queries()[name]
    want = sorted(map(tuple, query(spark, SMALL).collect()))
    monkeypatch.setattr(graph_queries, "TASK_ROWS", 300)
    more = query(spark, SMALL)
    assert more.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 300)
    assert sorted(map(tuple, more.collect())) == want
