"""Text queries: the number of tasks follows the texts' bytes, and a text is taken apart once."""

import pytest

from repolens.plans import registry, search_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["postings_tf", "tokenize_terms", "bm25_index_topk"])
def test_tasks_follow_the_bytes(spark, monkeypatch, name):
    query = registry.queries()[name]
    want = sorted(map(tuple, query(spark, SMALL).collect()))
    monkeypatch.setattr(search_queries, "TASK_BYTES", 20_000)
    docs = search_queries._by_doc(spark, SMALL)
    assert docs.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, query(spark, SMALL).collect())) == want


@pytest.mark.parametrize("name", ["doc_stats", "bm25_topk", "rrf_fusion"])
def test_a_text_is_taken_apart_once(spark, name):
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "split(" in line]
