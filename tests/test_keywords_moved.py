"""Keywords by tf-idf: rows of one id are one document, common and rare terms give one list, and whole term lists are moved once."""

import math
from collections import Counter

import pytest

from quern.plans import catalog, queries_text


@pytest.mark.parametrize("common", [2, 16_384])
def test_tfidf(spark, tmp_path, monkeypatch, common):
    monkeypatch.setattr(queries_text, "COMMON", common)
    texts = [(1, "alpha alpha beta gamma delta epsilon zeta"), (1, "alpha eta"), (2, "alpha beta theta theta"), (3, "alpha iota kappa"), (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = {}
    for k, t in texts:
        own.setdefault(k, Counter()).update((t or "").split())
    df = Counter(w for c in own.values() for w in c)
    want = set()
    for k, c in own.items():
        scores = sorted((-round(n / sum(c.values()) * max(0.0, math.log(len(texts) / df[w])), 6), w) for w, n in c.items())
        want |= {(k, w, -x) for x, w in scores[:5]}
    made = catalog.queries()["keywords_tfidf"](spark, str(tmp_path))
    assert {(r["doc_id"], r["term"], r["score"]) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan or plan.count("Window") >= 2
