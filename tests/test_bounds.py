"""A loop that ends at its bound says so instead of returning a part."""

import pytest

from sparkloom.operators import graph_metrics


def test_bounds_raise(spark):
    # Two cycles, the greater id first: one colour and so one component a round.
    edges = spark.createDataFrame([("d", "c"), ("c", "d"), ("c", "b"), ("b", "a"), ("a", "b")], "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {tuple(r) for r in graph_metrics.strong_components(edges, most_rounds=3, small=0).collect()} == {("a", "b"), ("b", "b"), ("c", "d"), ("d", "d")}
    for cut in (
        lambda: graph_metrics.strong_components(edges, most_rounds=1, small=0),
        lambda: graph_metrics.components(nodes, edges, most_rounds=1),
        lambda: graph_metrics.dependency_layers(nodes, edges, most=1),
        lambda: graph_metrics.reachable(edges, "d", most=2, small=0),
    ):
        with pytest.raises(RuntimeError):
            cut()
