"""Near-dedup and packing join tables that grow with the corpus in the executors, however small Spark thinks them."""

import pytest

from repolens.llm import components, orderminhash, packing


@pytest.fixture
def broadcasts(monkeypatch, spark):
    """Adds to a list the tables, by module, whose plan collects a join's side in the driver."""
    found, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for module in (orderminhash, components, packing):
        for name in ("cut", "stash"):
            if hasattr(module, name):

                def seen(df, *more, real=getattr(module, name), at=module.__name__):
                    if "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString():
                        found.append(at)
                    return real(df, *more)

                monkeypatch.setattr(module, name, seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield found
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _docs(spark):
    """Families with a common passage, so that every step has rows."""
    common = " ".join(f"c{i}" for i in range(60))
    texts = [f"{common} " + " ".join(f"f{k // 4}w{i + (k % 4 == 3) * (i == 5)}" for i in range(60)) + f" end{k % 2}" for k in range(24)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_near_dedup_collects_no_side_of_a_join(spark, broadcasts):
    kept = orderminhash.one_per_class(_docs(spark))
    assert "BroadcastExchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 8, 12, 16, 20]
    assert broadcasts == []


def test_a_packed_line_is_joined_in_the_executors(spark, broadcasts):
    import public_tokenizers

    plan = packing.pack(_docs(spark), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
