"""Incremental PageRank against the full run."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import graph, push


def ranks(df):
    return {r["node"]: r["rank"] for r in df.collect()}


def full(nodes, edges, d=0.5):
    """Power iteration in plain Python."""
    w = {}
    for a, b, c in edges:
        if a and b and c and c > 0:
            w[a, b] = w.get((a, b), 0) + c
    nodes = sorted(set(nodes) | {x for e in w for x in e})
    out = {}
    for (a, _), c in w.items():
        out[a] = out.get(a, 0) + c
    seed = {x: (1.0 if x in NAMED else 0.0) for x in nodes}
    y = dict(seed)
    for _ in range(400):
        new = {x: (1 - d) * seed[x] for x in nodes}
        for (a, b), c in w.items():
            new[b] += d * y[a] * c / out[a]
        y = new
    total = sum(y.values())
    return {x: v / total for x, v in y.items()}


NAMED = set()
SCHEMA = "source string, target string, confidence double"


def close(a, b):
    return set(a) == set(b) and all(abs(a[x] - b[x]) < 1e-7 for x in a)


def test_changes(spark):
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(60)]
    NAMED.clear()
    NAMED.update(nodes)
    edges = [(rng.choice(nodes[:50]), rng.choice(nodes), rng.choice([0.5, 1.0, 2.0])) for _ in range(200)] + [("n1", f"n{i}", 1.0) for i in range(60)] + [(None, "n2", 1.0), ("n2", "n3", None), ("n3", "n4", -1.0)]
    frame = spark.createDataFrame([(n, 1) for n in nodes], "id string, y int")
    state, _ = push.start(frame, spark.createDataFrame(edges, SCHEMA).withColumn("w", F.lit(7)), buckets=8, damping=0.5, left=1e-8)
    assert close(ranks(state.ranks()), full(nodes, edges))
    gone = [e for e in edges if e[0] == "n7"] + edges[:3]  # n7 loses all edges
    new = [("n55", "n1", 1.0), ("n7", "n9", 0.25), ("fresh", "n2", 1.0), ("n0", "fresh", 1.0)]
    report = push.change(state, spark.createDataFrame(new, SCHEMA), spark.createDataFrame(gone, SCHEMA), spark.createDataFrame([("lone",), (None,)], "id string"), left=1e-8)
    NAMED.add("lone")
    left = [e for e in edges if e not in gone] + new
    assert close(ranks(state.ranks()), full([*nodes, "lone"], left)) and report.count() > 1
    push.change(state, removed=spark.createDataFrame([e for e in left if e[0] and e[1] and e[2] and e[2] > 0], SCHEMA))  # no edge is left
    assert close(ranks(state.ranks()), full([*nodes, "lone", "fresh"], []))


def test_stays_near(spark):
    """A chain of many parts: a change in one part touches no other."""
    edges = [(f"{c}.{i}", f"{c}.{(i + 1) % 5}", 1.0) for c in range(200) for i in range(5)]
    NAMED.clear()
    NAMED.update(e[0] for e in edges)
    state, whole = push.start(spark.createDataFrame([(n,) for n in sorted(NAMED)], "id string"), spark.createDataFrame(edges, SCHEMA), damping=0.5, left=1e-7)
    assert max(r["touched"] for r in whole.collect()) == 1000
    report = push.change(state, spark.createDataFrame([("3.1", "3.3", 1.0)], SCHEMA), left=1e-8)
    assert max(r["touched"] for r in report.collect()) == 5 and max(r["frontier"] for r in report.collect()) <= 5
    got, want = ranks(state.ranks()), full([], [*edges, ("3.1", "3.3", 1.0)])
    assert all(abs(got[x] - want[x]) < 1e-7 for x in want)


def test_same_as_power_iteration(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.5), ("c", "d", 0.5)], SCHEMA)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    state, _ = push.start(nodes, edges, damping=0.5, left=1e-8)
    got, want = ranks(state.ranks()), ranks(graph.pagerank(nodes, edges, damping=0.5, tolerance=1e-9, rounds=300))
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-7 for x in want)
