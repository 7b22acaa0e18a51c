"""What keeps queries within their limits on larger tables, against plain loops."""

from quern.operators import graph
from quern.runtime import staged


def loop_ranks(nodes, edges, seeds, damping=0.4, tolerance=1e-6):
    w = {}
    for s, t, c in edges:
        w[s, t] = w.get((s, t), 0) + c
    total = {s: sum(c for (a, _), c in w.items() if a == s) for s, _ in w}
    r = {n: seeds.get(n, 0) / sum(seeds.values()) for n in nodes}
    rank, moved, rounds = dict(r), 1.0, 0
    while rounds < 100 and moved >= tolerance:
        lost = sum(rank[n] for n in nodes if n not in total)
        new = {n: (1 - damping) * r[n] + damping * lost * r[n] for n in nodes}
        for (s, t), c in w.items():
            new[t] += damping * c / total[s] * rank[s]
        moved, rank, rounds = max(abs(new[n] - rank[n]) for n in nodes), new, rounds + 1
    return rank


def test_pagerank_of_levels_and_cycles(spark):
    """Levels deeper than are taken out, a cycle, what lies behind it, and nodes that both kinds lead to."""
    chain = [(f"p{i}", f"p{i + 1}", 1.0) for i in range(8)]
    edges = [*chain, ("p2", "c0", 0.5), ("p0", "p5", 2.0), ("c0", "c1", 1.0), ("c1", "c2", 1.0), ("c2", "c0", 1.0), ("c2", "tail", 3.0), ("tail", "end", 1.0), ("p1", "end", 0.3), ("c0", "c0", 1.0)]
    nodes = sorted({n for e in edges for n in e[:2]} | {"alone"})
    for seeds in ({n: 1.0 + (n < "c3") for n in nodes}, {"p1": 3.0, "c1": 1.0}):
        made = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string, confidence double"), spark.createDataFrame(list(seeds.items()), "id string, p double"), damping=0.4)
        want = loop_ranks(nodes, edges, seeds)
        assert {r["node"]: round(r["rank"], 10) for r in made.collect()} == {n: round(x, 10) for n, x in want.items()}


def test_pagerank_without_cycles_needs_no_rounds(spark):
    """Ranks of all nodes were written once a round: some 60 tables for this graph."""
    edges = [(f"s{i}", f"p{(i * j) % 7}", 1.0) for i in range(9) for j in (1, 2, 5)] + [(f"p{i}", "top", 1.0) for i in range(3)]
    nodes = sorted({n for e in edges for n in e[:2]})
    before = len(staged(spark))
    made = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string, confidence double"), spark.createDataFrame([("p0", 3.0), ("p4", 1.0)], "id string, p double"))
    assert abs(sum(r["rank"] for r in made.collect()) - 1) < 1e-9
    assert len(staged(spark)) - before < 25


def test_sums_over_all_pairs_equal_those_of_all_paths(spark):
    """A cycle with trees on it, a tree alone, two nodes alone; the core has only the cycle's nodes, not all pairs."""
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0), ("a", "t1", 0.5), ("t1", "t2", 2.0), ("t1", "t3", 0.7), ("c", "u1", 0.3), ("x", "y", 1.0), ("y", "z", 2.0), ("y", "w", 0.5), ("w", "v", 1.0), ("p", "q", 4.0), ("t2", "t1", 3.0)]
    edges = spark.createDataFrame(rows, "source string, target string, confidence double")
    paths = graph.shortest_paths(edges, spark.createDataFrame([(n,) for n in sorted({n for r in rows for n in r[:2]})], "id string"))
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(graph.closeness_of_all(edges)) == told(graph.closeness(paths))
    assert told(graph.betweenness_of_all(edges)) == told(graph.betweenness(paths))
    assert graph.Stripped(edges).paths.count() == 4 * 4 + 2


def test_triangles_make_no_pairs_of_a_small_node_s_neighbours(spark):
    """Ten leaves that all see the same four hubs, and hubs of which two are neighbours: a path for each leaf, not six pairs."""
    rows = [(f"leaf{i}", f"hub{j}") for i in range(10) for j in range(4)] + [("hub0", "hub1")]
    made = graph.clustering(spark.createDataFrame(rows, "source string, target string"))
    assert {r["node"]: r["coefficient"] for r in made.collect()} == {**{f"leaf{i}": 0.166667 for i in range(10)}, **{f"hub{j}": 0.181818 if j < 2 else 0.0 for j in range(4)}}


def test_adaptive_search_reads_the_first_targets_of_a_name_only(spark):
    """Many questions of one name: the best of each are those of the whole list, also where rounding leaves ids to decide."""
    from quern.operators import searches

    edges = spark.createDataFrame([(f"S{i}", f"T{(7 * i + j) % 60:02d}", "A" if j % 2 else "B", None if j == 5 else 0.5 + (j * 13 % 29) / 60) for i in range(2) for j in range(30)], "source string, target string, relation_type string, confidence double")
    entities = spark.createDataFrame([(f"S{i}", "Same") for i in range(2)] + [(f"T{i:02d}", f"n{i % 9}") for i in range(60)], "id string, name string")
    types = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "relation_type string, vector array<double>")
    asks = spark.createDataFrame([("q1", "same", [1.0, 0.0]), ("q2", "SAME", [-1.0, 0.0]), ("q3", "Same", [0.3, 0.9]), ("q4", None, [1.0, 0.0])], "ask_id string, name string, vector array<double>")
    best = searches.entity_best(asks, entities, edges, types, 6)
    every = searches.entity_centric(asks, entities, edges, types)
    told = lambda df: sorted(tuple(r) for r in searches.adaptive_fusion(df, 5, 6).collect())
    assert told(best) == told(every)
    near = {r["ask_id"]: r["n"] for r in best.where("strategy = 'neighbour'").groupBy("ask_id").count().withColumnRenamed("count", "n").collect()}
    whole = {r["ask_id"]: r["n"] for r in every.where("strategy = 'neighbour'").groupBy("ask_id").count().withColumnRenamed("count", "n").collect()}
    assert near["q3"] <= 12 < whole["q3"]


def test_pairs_and_cells_are_dealt_into_parts(spark):
    """A label, and a cell, of more rows than a part: no pair and no neighbour is lost, and more tasks share them."""
    from quern.functions import vector as vx
    from quern.operators import retrieval as rt

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 120")
    made = {(r["a"], r["b"]): r["score"] for r in rt.group_pairs(v, "label", "vec_id", "embedding", 0.1, part=5).collect()}
    x, y = v.selectExpr("vec_id as a", "label", "embedding as x"), v.selectExpr("vec_id as b", "label", "embedding as y")
    want = {(r["a"], r["b"]): r["s"] for r in x.join(y, "label").where("a < b").select("a", "b", vx.cosine(x["x"], y["y"]).alias("s")).where("round(s, 6) > 0.1").collect()}
    assert made.keys() == want.keys() and all(abs(made[p] - want[p]) < 1e-6 for p in want)
    near = lambda df: {(r["query_id"], r["rank"], r["vec_id"]) for r in df.collect()}
    asked = v.where("vec_id % 20 = 0")
    assert near(rt.vector_ann(v, asked, cells=1, probes=1, part=7)) == near(rt.batch_search(v, asked))


def test_pairs_of_different_labels_are_made(spark):
    """The query's own pairs: of all vectors, also of unlike or missing labels, as brute force has them; without a group every length has its pairs."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from quern.functions import vector as vx
    from quern.operators import retrieval as rt
    from quern.plans.queries_answers import pairwise_similarities

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60").withColumn("label", F.expr("if(vec_id % 7 = 0, null, label)"))
    x, y = v.selectExpr("vec_id as a", "label as la", "embedding as x"), v.selectExpr("vec_id as b", "label as lb", "embedding as y")
    want = x.crossJoin(y).where("a < b").select("a", "b", "la", "lb", F.round(vx.cosine(F.col("x"), F.col("y")), 6).alias("s")).where("s > 0.1").collect()
    told = lambda df: {(r["a"], r["b"]): r["score"] for r in df.collect()}
    brute = {(r["a"], r["b"]): r["s"] for r in want}
    assert any(r["la"] is None or r["la"] != r["lb"] for r in want)
    for made in (told(pairwise_similarities(SimpleNamespace(embeddings=v))), told(rt.group_pairs(v, None, "vec_id", "embedding", 0.1, part=7))):
        assert made.keys() == brute.keys() and all(abs(made[p] - brute[p]) < 2e-6 for p in made)
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, [2.0]), (5, None)], "vec_id long, embedding array<double>")
    assert told(rt.group_pairs(mixed, None, "vec_id", "embedding", 0.1)).keys() == {(1, 2), (3, 4)}


def test_large_blocks_are_cut_into_chunks(spark, monkeypatch):
    """No pair of a block is lost or made twice, names stay on their side, keys that repeat too; and a part is copied for each chunk, not for each task."""
    from quern.plans import queries_more as qm

    rows = [(i // 2 if i % 50 == 1 else i, f"n{i}", f"b{0 if i % 4 else i % 3}", "t") for i in range(400)] + [(7, None, "b0", "t"), (None, "x", "b0", "t"), (8, "y", None, "t")]
    p = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string")
    want = sorted((a[0], b[0], a[1] or "", b[1] or "") for a in rows for b in rows if None not in (a[0], b[0], a[2], b[2]) and a[2] == b[2] and a[0] < b[0])
    monkeypatch.setattr(qm, "CHUNK", 40)
    monkeypatch.setattr(qm, "TASK", 1600)
    made = qm._pairs(p, "p_name", 150_000.0, 335.0**2)
    assert sorted((r["a"], r["b"], r["x"] or "", r["y"] or "") for r in made.collect()) == want
    copies = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.repartition", lambda df, *_: copies.append(df.count()) or df)
    qm._pairs(p, "p_name", 150_000.0, 335.0**2)
    assert sum(copies) <= len(rows) * (335 / 40 + 3)
