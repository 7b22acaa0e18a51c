"""A walk makes distinct what it meets, not the pairs of the whole graph."""

from quern.operators import graph


def test_bfs_without_a_list_of_all_pairs(spark, monkeypatch):
    def refused(edges):
        raise AssertionError("all pairs were listed")

    monkeypatch.setattr(graph, "undirected", refused)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("d", "c"), (None, "a"), ("x", "y")], "source string, target string")
    got = graph.bfs(edges, spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]
