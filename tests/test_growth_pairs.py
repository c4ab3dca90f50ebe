"""Callers times symbols of a common name: tasks follow the rows made, and the rows take little room in files."""

import pytest
from pyspark.sql import functions as F

from repolens.operators import graph
from repolens.plans import registry

SMALL = "/root/testdata/sf0.001"
CALLERS, SYMBOLS = 96, 45_000


def test_rows_of_a_common_name_take_little_room(spark, tmp_path):
    calls = spark.range(CALLERS).select(F.col("id").alias("caller"), F.lit("www.a.b").alias("called"))
    symbols = spark.range(SYMBOLS).select(F.concat("id", F.lit("::www.a.b")).alias("id"), F.lit("www.a.b").alias("short"))
    out = str(tmp_path / "pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        graph.resolve_calls(calls, symbols, "caller", "called", "id", "short").write.option("compression", "snappy").parquet(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = spark.read.parquet(out)
    assert found.count() == found.dropDuplicates(["caller", "symbol_id"]).count() == CALLERS * SYMBOLS
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * CALLERS * SYMBOLS


def test_tasks_follow_the_rows_made(spark, monkeypatch):
    calls = spark.createDataFrame([(i, "a.b" if i % 3 else "b") for i in range(200)] + [(None, "a.b"), (7, None)], "caller long, called string")
    symbols = spark.createDataFrame([(f"{i}::a.b", "a.b") for i in range(50)] + [(None, "a.b"), ("x", None)], "id string, short string")
    found = lambda: graph.resolve_calls(calls, symbols, "caller", "called", "id", "short")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(found())
    assert len(want) == len(set(want)) == 201 * 51
    for name, value in (("PIECE", 8), ("SIDE", 6), ("TASK_PAIRS", 1000)):
        monkeypatch.setattr(graph, name, value)
    dealt = found().select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted(str(r).replace(f", task={r['task']})", ")") for r in dealt) == want
    assert len({r["task"] for r in dealt}) > 5 and max(sum(r["task"] == t for r in dealt) for t in {r["task"] for r in dealt}) < 201 * 51 / 4


@pytest.mark.parametrize("name", ["resolve_calls", "resolve_calls_unique"])
def test_small_pieces_change_nothing(spark, monkeypatch, name):
    query = registry.queries()[name]
    want = sorted(map(tuple, query(spark, SMALL).collect()))
    for part in ("PIECE", "SIDE", "TASK_PAIRS"):
        monkeypatch.setattr(graph, part, 2)
    assert sorted(map(tuple, query(spark, SMALL).collect())) == want
