"""Calls by a name that many use are paired in pieces."""

from repolens.operators import graph


def test_callers_of_a_common_name_are_dealt_in_pieces(spark, monkeypatch):
    calls = spark.createDataFrame([(i, "a.b" if i % 3 else "b") for i in range(200)] + [(0, "a.b"), (999, "nothing")], "caller long, called string")
    symbols = spark.createDataFrame([(f"{i}::a.b", "a.b") for i in range(50)], "id string, short string")
    found = lambda: sorted(map(tuple, graph.resolve_calls(calls, symbols, "caller", "called", "id", "short").collect()))
    want = found()
    assert len(want) == 201 * 50
    monkeypatch.setattr(graph, "PIECE", 7)
    assert found() == want
