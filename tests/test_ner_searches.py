"""Custom rules and the choice among results, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import ner, retrieval, searches
from quern.operators.ner import Rule

RULES = [
    Rule("exact", "exact", "A", "Anna", 9), Rule("dict", "dictionary", "D", priority=8), Rule("number", "regex", "N", r"\d+(?:\.\d+)?", 7), Rule("context", "contextual", "C", "an|o|to", 6),
    Rule("pre", "prefix", "P", "Mc", 5), Rule("suf", "suffix", "S", "TON", 4), Rule("has", "contains", "H", "x", 3), Rule("none", "exact", "Z", "", 2), Rule("bad", "contextual", "Z", "a|b", 1),
]
DICTIONARY = {"D": ["tom", "tom sawyer", "aa", "", "É"]}


def by_loops(text, rules, dictionary):
    low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    found, rules = [], sorted(rules, key=lambda r: -r.priority)
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\f]+", low)]
    for i, r in enumerate(rules):
        p = r.pattern.lower()
        if r.kind in ("exact", "dictionary"):
            for w in {x.lower() for x in ([r.pattern] if r.kind == "exact" else dictionary.get(r.entity_type, [])) if x}:
                at = low.find(w)
                while at >= 0:
                    found.append((at, -ner.SURE[r.kind], i, at + len(w)))
                    at = low.find(w, at + len(w))
        elif r.kind == "regex":
            found += [(m.start(), -0.9, i, m.end()) for m in re.finditer(r.pattern, text)]
        elif r.kind == "contextual" and p.count("|") == 2:
            b, t, a = p.split("|")
            found += [(words[j][0], -0.85, i, words[j][1]) for j in range(1, len(words) - 1) if b in low[slice(*words[j - 1])] and t in low[slice(*words[j])] and a in low[slice(*words[j + 1])]]
        elif p and r.kind != "contextual":
            test = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}[r.kind]
            found += [(a, -ner.SURE[r.kind], i, b) for a, b in words if test(low[a:b], p)]
    out, last = [], 0
    for a, c, i, b in sorted(found):
        if a >= last:
            out.append((a, b, text[a:b], rules[i].entity_type, -c, rules[i].name))
            last = b
    return out


def test_rules(spark):
    rng = random.Random(1)
    pool = ["Anna", "anna's", "Tom", "Sawyer", "tom sawyer", "aaaa", "3.14", "12x", "McCoy", "Boston", "to", "can", "of", "no", "É", "İx", "x", ",", "\n", "  "]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["", None, "Anna" * 500]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, rule string")
    got = {}
    for r in ner.extract(frame, RULES, DICTIONARY).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["text"], r["entity_type"], r["confidence"], r["rule"]))
    assert {r for v in got.values() for *_, r in v} == {"exact", "dict", "number", "context", "pre", "suf", "has"}
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == by_loops(t or "", RULES, DICTIONARY)


def test_rules_refused(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        ner.extract(frame, [Rule("x", "guess", "T", "a")])
    monkeypatch.setattr(ner, "DICTIONARY", 3)
    with pytest.raises(ValueError):
        ner.extract(frame, [Rule("x", "dictionary", "T")], {"T": ["long entry"]})
    assert ner.extract(frame.limit(0), RULES, {}).count() == 0


def chosen(results, k):
    """The choice by loops; results: (id, name, score)."""
    best = {}
    for i, n, s in results:
        if i not in best or s > best[i][1]:
            best[i] = (n, s)
    order = sorted(best, key=lambda i: (-best[i][1], i))
    out, seen = [], set()
    for i in order:
        if len(out) < k and (best[i][1] > 0.8 or best[i][0] not in seen or len(out) < k // 2):
            out.append(i)
            seen.add(best[i][0])
    return (out + [i for i in order if i not in out])[:k]


def test_adaptive_fusion(spark):
    rng = random.Random(2)
    rows = [(f"q{q}", f"i{rng.randrange(40):02}", f"n{rng.randrange(6)}", round(rng.random(), 1), "s") for q in range(12) for _ in range(rng.randint(1, 60))]
    rows = [(q, i, f"n{int(i[1:]) % 6}", s, x) for q, i, _, s, x in rows]
    made = searches.adaptive_fusion(spark.createDataFrame(rows, "ask_id string, id string, name string, score double, strategy string"), 10).collect()
    for q in {r[0] for r in rows}:
        assert [r["id"] for r in sorted((r for r in made if r["ask_id"] == q), key=lambda r: r["place"])] == chosen([(i, n, s) for a, i, n, s, _ in rows if a == q], 10)


def test_searches_on_odd_rows(spark):
    entities = spark.createDataFrame([("a", "Anna", [1.0, 0.0]), ("b", "Bob", [0.0, 1.0]), ("c", "anna", None), ("d", None, [1.0, 1.0])], "id string, name string, vector array<double>")
    edges = spark.createDataFrame([("a", "b", "KNOWS", 0.5), ("a", "b", "LIKES", 1.0), ("c", "d", "KNOWS", 1.0), ("a", "nobody", "KNOWS", 1.0)], "source string, target string, relation_type string, confidence double")
    types = spark.createDataFrame([("KNOWS", [1.0, 0.0])], "relation_type string, vector array<double>")
    asks = spark.createDataFrame([("q1", "ANNA", [1.0, 0.0]), ("q2", None, [0.0, 1.0]), ("q3", "Zoe", None)], "ask_id string, name string, vector array<double>")
    found = {(r["ask_id"], r["id"], r["strategy"]): r["score"] for r in searches.entity_centric(asks, entities, edges, types).collect()}
    assert found == {("q1", "a", "entity"): 0.9, ("q1", "c", "entity"): 0.9, ("q1", "b", "neighbour"): 0.7, ("q1", "d", "neighbour"): 1.4}
    near = {(r["ask_id"], r["id"]): r["score"] for r in searches.community_based(asks, entities, edges, 2).collect()}
    assert near == {("q1", "a"): pytest.approx(1.3), ("q1", "d"): pytest.approx(0.707107), ("q2", "b"): 1.0, ("q2", "d"): pytest.approx(0.707107)}
    assert searches.execute_adaptive(asks, entities, edges, types).count() > 0 and searches.adaptive_fusion(searches.entity_centric(asks.limit(0), entities, edges, types)).count() == 0


def test_community_search_leaves_out_what_no_likeness_can_lift(spark):
    rng = random.Random(7)
    rows = [(f"e{i:03}", f"n{i}", [rng.uniform(-1, 1) for _ in range(3)], rng.choice([0, 1, 30, 31, 45, 50])) for i in range(200)]
    entities = spark.createDataFrame([r[:3] for r in rows], "id string, name string, vector array<double>")
    edges = spark.createDataFrame([(r[0], f"t{j}") for r in rows for j in range(r[3])], "source string, target string")
    asks = spark.createDataFrame([(f"q{i}", None, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(20)], "ask_id string, name string, vector array<double>")
    made = searches.community_based(asks, entities, edges, 3)
    got = {}
    for r in made.collect():
        got.setdefault(r["ask_id"], []).append((-r["score"], r["id"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for ask in asks.collect():
        assert sorted(got[ask["ask_id"]]) == sorted((-round(cos(ask["vector"], v) + 0.1 * n, 6), i) for i, _, v, n in rows)[:3]
    scored = entities.join(edges.groupBy(F.col("source").alias("id")).agg((0.1 * F.count("*")).alias("bonus")), "id", "left")
    compared = retrieval.batch_search(scored, asks.select(F.col("ask_id").alias("id"), "vector"), "id", "vector", 3, bonus="bonus")
    assert re.search(r"_bonus#\d+ >= 2\.9", compared._jdf.queryExecution().optimizedPlan().toString())  # of 200 rows those of 50, 45, 31 and 30 edges


def test_hierarchical(spark):
    found = spark.createDataFrame([("t", f"n{i}", i / 10) for i in range(10)] + [("u", "n1", 0.5)], "tree string, id string, score double")
    rows = searches.hierarchical(found, "overview").collect()
    assert {(r["tree"], r["id"], r["score"]) for r in rows} == {("t", "n9", 1.2), ("t", "n8", 1.1), ("t", "n7", 1.0), ("u", "n1", 0.8)}
    assert searches.hierarchical(found, "brief").count() == 6
