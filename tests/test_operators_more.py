"""Operators that SQL doesn't express, against brute force or by hand on small fixtures."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import similarity
from quern.functions import text as tx
from quern.operators import concepts, corpus, graph, layout, linking, metrics, persons, retrieval, temporal, tree
from quern.operators import entities as en
from quern.plans import catalog, queries_more
from quern.runtime import hot_keys, replicate_join, shared_dir, stage
from quern.sources import importers, stores


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def edges(spark, values):
    return rows(spark, values, "source string, target string, confidence double")


def test_replicate_join_of_hot_keys(spark):
    left = stage(spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("a"), F.col("id").alias("b")), "left")
    right = spark.range(0, 900, 2).select(F.col("id").alias("a"), (F.col("id") * 2).alias("x"))
    hot = hot_keys(left, ["a"])
    assert [r.hot for r in hot.collect()] == [7]
    right = right.union(spark.createDataFrame([(7, 14)], "a long, x long"))
    want = sorted(map(tuple, left.join(right, "a").select("a", "b", "x").collect()))
    got = replicate_join(left, right, "a", "b", hot).select("a", "b", "x")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2000


def test_shared_dir_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def brute_stars(names, near):
    seeds, out = [], {}
    for n in sorted(names):
        of = [s for s in seeds if near(s, n)]
        if of:
            out[n] = of[0]
        else:
            seeds.append(n)
            out[n] = n
    return out


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    base = ["plato", "aristotle", "socrates", "red gear", "red geer", "blue gear"]
    names = list(dict.fromkeys(base + ["".join(c if rng.random() > 0.12 else rng.choice("aeiou") for c in rng.choice(base)) for _ in range(80)]))
    table = rows(spark, [(i, n.title(), "A" if i % 3 else "B", 0.5 + i % 5 / 10) for i, n in enumerate(names)], "id long, name string, kind string, confidence double")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    edit = lambda a, b: 0.0 if distance(a, b) > 2 else 1 - distance(a, b) / max(len(a), len(b))
    want = brute_stars(names, lambda a, b: edit(a, b) >= 0.8)
    assert {r.name: r.cluster for r in linking.link_fuzzy(table, 0.8).collect()} == want
    words = lambda x: set(x.split())
    best = lambda a, b: max(edit(a, b), similarity.jaro_winkler(a, b) if words(a) & words(b) or distance(a, b) <= 2 else 0, len(words(a) & words(b)) / len(words(a) | words(b)))
    kinds = {n: "A" if i % 3 else "B" for i, n in enumerate(names)}
    got = {r.name: r.cluster for r in linking.link_similar(table, 0.85).collect()}
    for kind in "AB":
        own = [n for n in names if kinds[n] == kind]
        assert {n: got[n] for n in own} == brute_stars(own, lambda a, b: best(a, b) >= 0.85)
    every = linking.link_hybrid(table.union(table.limit(1)), 0.8)
    assert {r.how for r in every.collect()} == {"exact", "fuzzy"} and every.count() == len(names) + 1


def test_extractors(spark):
    text = "Dr. Smith of Acme Corp met Anna in Paris. The Theory of war, at the University of Athens. Éa Zx"
    df = rows(spark, [(1, text), (2, None), (3, "")], "doc_id long, text string")
    names = lambda d: sorted(r.name for r in d.collect())
    assert names(en.organisations(df)) == ["Corp", "University of Athens"]
    assert names(en.dictionary(df, en.EVENTS, 0.7)) == ["war"] and names(en.dictionary(df, en.LOCATIONS, 0.5, any_case=False)) == ["Paris"]
    assert "Theory" in names(en.concepts(df)) and "Anna" in names(en.generic(df)) and "The" not in names(en.generic(df, least=2))
    found = {(r.name, r.entity_type): r.confidence for r in persons.extract(df).collect()}
    assert found["Theory", "CONCEPT"] == 0.75 and found["Paris", "LOCATION"] == pytest.approx(0.9) and found["University of Athens", "ORGANIZATION"] == pytest.approx(0.8)
    m = en.mentions(rows(spark, [(1, "anna (anna) annanna", "anna"), (2, "x", "anna"), (3, "a.b.a.b", "a.b")], "doc_id long, text string, name string"))
    assert sorted((r.doc_id, r.start, r.end) for r in m.collect()) == [(1, 0, 4), (1, 6, 10), (1, 12, 16), (3, 0, 3), (3, 4, 7)]
    odd = en.mentions(rows(spark, [(1, "a\\Eb a\\Eb", "a\\Eb"), (2, None, "x"), (3, "x", None), (4, "x", "")], "k long, n string, start string").toDF("k", "text", "name"))
    assert sorted((r.k, r.start, r.end) for r in odd.collect()) == [(1, 0, 4), (1, 5, 9)]
    word = lambda w: spark.range(1).select(en.person_word(F.lit(w)).alias("v")).head().v
    assert word("Anna") and word("O'Connor") and word("De") and not word("It") and not word("anna") and not word("A1")
    kind = lambda f, n: spark.range(1).select(f(F.lit(n)).alias("v")).head().v
    assert [kind(en.type_of_fact, n) for n in ("Scotland", "Plato", "428 BC", "virtue")] == ["LOCATION", "PERSON", "DATE", "CONCEPT"]
    assert [kind(en.type_by_guess, n) for n in ("Acme Inc", "New York City", "Plato", "The Person Next Door")] == ["organization", "location", "person", "person"]


def test_phrase_relations_turn_round(spark):
    df = rows(spark, [(1, "Anna works at Acmecorp"), (2, "Zeno founded Acmecorp"), (3, "Acmecorp founded by Zeno")], "doc_id long, text string")
    got = {r.doc_id: (r.source, r.target, r.relation_type, r.confidence) for r in en.phrase_relations(df, en.indexed(df)).collect()}
    assert got[1] == ("Acmecorp", "Anna", "works_at", 0.9)  # a later name that stands first turns works_at round
    assert got[3][2:] == ("founded", 0.8) and got[2] == ("Zeno", "Acmecorp", "founded", 1.0)


def test_graph_measures(spark):
    g = edges(spark, [("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)])
    starts = rows(spark, [(x,) for x in "ABCD"], "id string")
    paths = graph.shortest_paths(g, starts)
    assert {r.node: r.closeness for r in graph.closeness(paths).collect()} == {"A": 0.5, "B": 0.75, "C": 0.75, "D": 0.5}
    assert {r.node: (r.paths, r.betweenness) for r in graph.betweenness(paths).collect()} == {"B": (4, 1.333333), "C": (4, 1.333333)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(g, starts, most_rounds=1)
    hops = {r.node: r.path for r in graph.hop_paths(g, rows(spark, [("A",)], "id string"), 2).collect()}
    assert hops == {"A": ["A"], "B": ["A", "B"], "C": ["A", "B", "C"]}


def test_pagerank_against_numpy(spark):
    rng = random.Random(5)
    n = 30
    e = [(f"n{rng.randrange(n - 5)}", f"n{rng.randrange(n)}", round(rng.random() + 0.1, 3)) for _ in range(90)]
    m = np.zeros((n, n))
    for a, b, w in e:
        m[int(a[1:]), int(b[1:])] += w
    out = m.sum(axis=1)
    share = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    r = now = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.15 * r + 0.85 * (share.T @ now + now[out == 0].sum() * r)
        moved, now = np.abs(new - now).max(), new
        if moved < 1e-6:
            break
    got = {x.node: x["rank"] for x in graph.pagerank(rows(spark, [(f"n{i}",) for i in range(n)], "id string"), edges(spark, e)).collect()}
    assert all(got[f"n{i}"] == pytest.approx(now[i], abs=1e-12) for i in range(n))


def test_causal_chains(spark):
    e = rows(spark, [("A", "B", 0.8, 0.5, 100), ("B", "C", 0.5, None, 50), ("C", "A", 0.9, None, 10), ("A", "X", 0.2, 0.9, 1)], "source string, target string, confidence double, causal_strength double, at long")
    got = {r.path: (r.confidence, r.consistent, r.span) for r in graph.causal_chains(e, rows(spark, [("A",), ("C",)], "id string"), 4).collect()}
    assert got == {"A>B": (0.6, True, 0), "A>B>C": (0.21, False, -50), "C>A>B": (0.378, True, 90)}


def test_label_communities_are_better_than_single_nodes(spark):
    rng = random.Random(1)
    e = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i in range(8) for j in range(i) if rng.random() < 0.7] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    g = edges(spark, e)
    labels = graph.label_communities(g, 8)
    single = labels.select("node", F.col("node").alias("community"))
    m = lambda c: graph.modularity(g, c).head().modularity
    assert m(labels) > 0.4 > m(single)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_vector_ann_recall(spark, scale):
    """With the registered query's own parameters."""
    v = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in retrieval.batch_search(v, v.where("vec_id % 20 = 0"), k=10).collect()}
    near = {(r.query_id, r.vec_id) for r in catalog.queries()["vector_ann"](spark, f"/root/testdata/sf{scale}").collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_vectors_that_take_no_part(spark):
    schema = "vec_id long, embedding array<float>, score string"
    good = [(i, [float(i % 7 + 1), float(i % 5), 1.0], "clash") for i in range(40)] + [(3, [9.0, 1.0, 1.0], "twice"), (90, [0.0, 0.0, 0.0], "zero")]
    odd = [(50, None, ""), (51, [1.0, None, 2.0], ""), (52, [1.0], ""), (53, [], ""), (None, [1.0, 1.0, 1.0], "")]
    told = lambda df: sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())
    clean, every = rows(spark, good, schema), rows(spark, good + odd, schema)
    assert told(retrieval.batch_search(every, every, k=3)) == told(retrieval.batch_search(clean, clean, k=3, block=7, part=9))
    assert {q for q, *_ in told(retrieval.vector_ann(every, every, k=3))} <= {g[0] for g in good}
    for search in (retrieval.batch_search, retrieval.vector_ann):
        assert search(every.limit(0), every).count() == 0 and search(every, every.limit(0)).count() == 0


def test_pagerank_without_weights(spark):
    """A node whose weights sum to nothing is dangling; null ends are no edges, seeds of one node add up."""
    g = edges(spark, [("A", "B", 0.0), ("A", "C", 0.0), ("B", "C", 1.0), (None, "A", 1.0), ("C", None, 1.0)])
    nodes = rows(spark, [(x,) for x in "ABC"], "id string")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(nodes, g).collect()}
    assert set(ranks) == set("ABC") and sum(ranks.values()) == pytest.approx(1, abs=1e-5) and ranks["C"] > ranks["A"] == pytest.approx(ranks["B"], abs=1e-5)
    seeded = graph.pagerank(nodes, g, rows(spark, [("A", 1.0), ("A", 1.0), ("B", 2.0)], "id string, p double")).collect()
    assert len(seeded) == 3 and sum(r["rank"] for r in seeded) == pytest.approx(1, abs=1e-5)


def test_stores(spark):
    v = lambda *ids: rows(spark, [(i, [float(i), 1.0]) for i in ids], "id long, embedding array<float>")
    one = stores.VectorStore(spark).add(v(1, 2)).add(rows(spark, [(2, [9.0, 9.0])], "id long, embedding array<float>")).commit()
    assert one.get(2) == [9.0, 9.0] and one.get(7) is None and one.contains(1) and not one.remove(v(1)).contains(1) and one.contains(1)
    assert [r.id for r in one.search([1.0, 1.0], 1).collect()] == [1] and sorted(r.id for r in one.ids().collect()) == [1, 2]
    assert stores.VectorStore(spark).rows().count() == 0


def test_temporal_joins(spark):
    rng = random.Random(2)
    e = [(rng.choice("uv"), "t", rng.choice("xy"), a, a, a + rng.randrange(0, 250_000)) for a in (rng.randrange(0, 600_000) for _ in range(60))]
    t = rows(spark, e, "source string, target string, edge_type string, at long, start_at long, end_at long")
    want = sorted((a[0], a[3], b[3]) for a in e for b in e if a is not b and a[0] == b[0] and a[4] <= b[5] and b[4] <= a[5] and (a[3], a[2]) < (b[3], b[2]))
    assert sorted((r.source, r["at"], r.b_at) for r in temporal.overlapping(t).collect()) == want
    left = rows(spark, [(1, "u", 10), (2, "u", 5), (3, "w", 9)], "id long, source string, at long")
    right = rows(spark, [("u", 5), ("u", 7), ("u", 11), ("z", 1)], "source string, seen long")
    assert {r.id: r.seen for r in temporal.as_of(left, right, "source", "at", "seen").collect()} == {1: 7, 2: 5, 3: None}


def test_layout(spark):
    text = "Title\n=====\n\n# One\ntext\n## Two\n- a\n- b\n\n```\ncode\n```\n### Three\n## Four. It ends here. Yes\n# Five"
    df = rows(spark, [(1, text)], "k long, text string")
    h = layout.markdown(df, "k")
    assert [(r.level, r.title, r.start) for r in h.orderBy("at").collect()] == [(len(m[1]), m[2], m.start()) for m in re.finditer(r"^(#+) (.*)$", text, re.M)]
    tree_ = {r["at"]: (r.parent_at, r.depth, r.path) for r in layout.hierarchy(h, "k").collect()}
    assert tree_[2] == (1, 3, "One > Two > Three") and tree_[3][:2] == (0, 2) and tree_[4] == (None, 1, "Five")
    found = {(r.position, r.kind) for r in layout.boundaries(df, "k").collect()}
    assert {(0, "heading"), (text.index("- a"), "list"), (text.index("- b"), "list"), (text.index("```"), "code"), (text.index("\n\n#"), "paragraph"), (text.index(". Yes"), "sentence")} <= found
    number = lambda s: spark.range(1).select(layout.section_number(F.lit(s)).alias("v")).head().v
    assert [number(s) for s in ("1.2 A", "Chapter 7", "XIV. B", "B) c", "none")] == ["1.2", "7", "14", "B", None]
    parts = spark.range(1).select(layout.paragraphs(F.lit("aa\n\nbb\n\n \n\ncccccc"), 7).alias("v")).head().v
    assert parts == ["aa\n\nbb", "cccccc"]


def test_concepts(spark):
    text = "Red Gear meets the Red Gear. NASA and ESA LAB; once, twice twice thrice thrice. The Of And In Gear"
    got = {r.concept: r.n for r in concepts.noun_concepts(rows(spark, [(1, text)], "doc_id long, text string"), "doc_id").collect()}
    assert got["red gear"] == 2 and got["nasa"] == 1 and got["esa lab"] == 1 and got["twice"] == 2 and "once" not in got and "the of and in gear" not in got
    rel = rows(spark, [("a", "b", 0.5), ("b", "c", 0.9), ("c", "d", 0.1)], "name string, other string, confidence double")
    counts = rows(spark, [(x, 3) for x in "abcd"], "name string, chunks long")
    refined = {r.name: r["round"] for r in concepts.refine(counts.limit(1), rel, counts).collect()}
    assert refined == {"a": 0, "b": 1, "c": 2, "d": 3}
    mentions = rows(spark, [("a", 1, 0), ("b", 1, 0), ("b", 2, 0), ("c", 3, 0)], "name string, doc_id long, at long")
    assert [(r.depth, r.concepts, r.chunks) for r in concepts.deepen(counts.limit(1), rel, mentions).orderBy("depth").collect()] == [(0, 1, 1), (1, 2, 2), (2, 3, 3)]
    docs = rows(spark, [(1, "Big system and red process. Big system"), (2, "A big system")], "doc_id long, text string")
    found = {r.concept: (r.mentions, r.documents) for r in corpus.clusters(docs, [r"\\b\\w+ system\\b".replace("\\\\", "\\"), r"\\b\\w+ process\\b".replace("\\\\", "\\")]).collect()}
    assert found == {"big system": (3, 2), "red process": (1, 1)}


def test_trees_and_metrics(spark):
    c = rows(spark, [(1, i, i * 10, f"word{i % 3} tail") for i in range(11)] + [(2, 0, 0, "alone")], "doc_id long, at long, start_offset long, content string")
    nodes = tree.build(c, merge=5).collect()
    levels = {(r.doc_id, r.level, r["at"]): r for r in nodes}
    assert levels[1, 2, 0].children == 3 and levels[1, 1, 2].content == "word1 tail" and levels[1, 1, 0].content.count("\n\n") == 4 and (2, 1, 0) not in levels
    assert levels[1, 2, 0].start == 0 and levels[1, 2, 0].keywords == ["tail", "word0", "word1", "word2"]
    assert similarity.bleu_of("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0) and similarity.bleu_of("a b".split(), "a b c d".split()) == 0.0
    assert similarity.bleu_of("a b c d x".split(), "a b c d e".split()) == pytest.approx((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    h = metrics.histogram(rows(spark, [("k", float(v)) for v in [1, 1, 2, 3, 9]], "k string, v double"), "k", "v").head()
    assert (h.n, h.p50, h.p95, h.p99) == (5, 2.0, 9.0, 9.0)
    match = lambda a, b: spark.range(1).select(tx.edit_name_match(F.lit(a), F.lit(b)).alias("v")).head().v
    assert match("Tom Sawyer", "Tom") and match("Huck Finn", "Mick Finn") and match("Becky", "Bekky Thatcher") is False and match("Aunt Polly", "Aunt Poly")


@pytest.mark.parametrize("name", ["levenshtein_similarity", "jaccard_tokens", "jaro_winkler", "soundex_phonetic", "fuzzy_text_similarity", "name_similarity_logic", "string_similarity_contain"])
def test_a_pair_of_names_is_scored_once(spark, tmp_path, monkeypatch, name):
    names = ["red ring", "Red ring", "red", "", None, "blue bolt", "bolt"]
    rows = [(i, names[i * i % 11 % 7], f"b{i % 2}", "t" if i % 13 else None) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    monkeypatch.setattr(queries_more, "_pairs", lambda p, x, *rest, own=queries_more._pairs: seen.append(x) or own(p, x, *rest))
    monkeypatch.setattr(queries_more, "TASK", 1000)  # blocks are dealt out
    made = catalog.queries()[name](spark, str(tmp_path))
    told = lambda df: sorted(map(repr, df.collect()))
    got = told(made)
    assert seen == ["n"] and made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    monkeypatch.setattr(queries_more, "REPEATED", 1e9)
    assert told(catalog.queries()[name](spark, str(tmp_path))) == got and seen == ["n", "p_name"]
    assert len(got) == sum(a[2] == b[2] and a[3] == b[3] == "t" for a, b in itertools.combinations(rows, 2))


def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = {f"{i}.html": "é" * i for i in range(30)} | {"none.txt": None}
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("files go through the driver"))
    importers.write_files(rows(spark, list(texts.items()), "name string, text string"), f"{tmp_path}/made", each=10)
    assert {p.name: p.read_bytes() for p in (tmp_path / "made").iterdir()} == {n: (x or "").encode() for n, x in texts.items()} and {p.name for p in tmp_path.iterdir()} == {"made"}
    importers.write_files(rows(spark, [], "name string, text string"), f"{tmp_path}/empty")
    assert importers.corpus_folder(spark, f"{tmp_path}/empty").count() == 0
