"""Collocations against counting every phrase, and the automaton against counting every substring."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, queries
from quern.llm.sql import OP11

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long"
PIECES, WORDS = re.compile("[.,;:!?\n\x0b\x0c\r]"), re.compile("[^ \t]+")


def expected(rows, least, most, share=100, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in map(WORDS.findall, PIECES.split(low)):
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    dropped = {(p[0], *q) for p, c in f.items() for k in range(2, len(p) - 1) for q in [p[i : i + k] for i in range(1, len(p) - k + 1)] if len(q) < len(p) - 1 and 100 * c >= share * f[(p[0], *q)]}
    out = []
    for p, a in f.items():
        if len(p) > 2 and p not in dropped:
            score, _, left, right = min((1000 * a * n[p[0]] // (f[p[:j]] * f[(p[0], *p[j:])]), j, f[p[:j]], f[(p[0], *p[j:])]) for j in range(2, len(p)))
            out.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    ranked, rank = set(), Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            ranked.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return ranked


def corpus():
    rng = random.Random(7)
    word = lambda: f"w{int(rng.random() ** 3 * 60)}"
    rows = []
    for i in range(250):
        text = "".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "?!"]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text + rng.choice(["", " The Big red Fox runs", " the big red fox", " É über straße"]), rng.choice(["en", "en", "de", None]), i))
    return rows + [(900, None, "en", 0), (901, "", None, 0), (902, " ,;. \n", "en", 0), (None, "go " * 3000, "en", 0), (903, "a b " * 200, "fr", 0)] + [rows[3]] * 30


def got(df, **kw):
    return {tuple(r) for r in collocations.mine(df, **kw).collect()}


def test_against_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit(1)).withColumn("pair", F.lit("x")).repartition(5)
    for least, most in ((20, 2000), (8, 25)):
        want = expected(rows, least, most)
        assert len(want) > 40 and got(df, least=least, most=most) == want


def test_small_shards_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("PART", 64), ("RANKED", 10), ("MERGE", 2), ("BITS_A_GRAM", 1)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()[:120] + corpus()[250:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, least=10, most=30) == expected(rows, 10, 30)
    assert got(df, least=10, most=500, share=80) == expected(rows, 10, 500, 80)


@pytest.mark.parametrize("seed", range(6))
def test_automaton(seed):
    rng = random.Random(seed)
    a, want = collocations.Automaton(), Counter()
    for _ in range(rng.randint(1, 30)):
        s, weight = [rng.randrange(3) for _ in range(rng.randint(1, 30))], rng.randint(1, 3)
        a.add(s, weight)
        for k in range(2, 6):
            for i in range(len(s) - k + 1):
                want[tuple(s[i : i + k])] += weight
    made = [(tuple(a.words[e - n + 1 : e + 1]), c) for e, n, c in a.phrases(5)]
    assert len(made) == len(set(p for p, _ in made)) and dict(made) == dict(want)
    assert len(a.link) <= 2 * len(a.words) + 1 and all(a.length[a.link[v]] < a.length[v] for v in range(1, len(a.link)))


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == set()
    assert got(spark.createDataFrame([(1, "one two", "en", 0), (2, None, None, 0)], SCHEMA)) == set()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(OP11).fetchall()}
    assert want and {tuple(r) for r in queries.op11_collocations(spark, SF).collect()} == want
