"""Each stage of the pipeline against brute force on what the stage before kept."""

import hashlib
import random

import numpy as np
import pytest
from test_operators import brute_components, brute_report, corpus, frame, tik, words

import corpus_pipeline
from quern.llm import ordinal
from quern.runtime import stage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    rows = corpus(12)
    items = [(i, words(rng, 14, 5000)) for i in range(6)]
    rows += [(2000 + i, words(rng, 40, 5000) + " " + t + " " + words(rng, 10, 5000)) for i, t in items]
    rows += [(3000 + i, " ".join(w + "!!!" for w in words(rng, 30, 5000).split())) for i in range(60)]
    rows += [(4000 + i, words(rng, 30, 5000)) for i in range(60)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(3000 + i, 0, 0) for i in range(40)] + [(4000 + i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [stage(docs, "documents")]
    for name, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], folder), "stage"))
    for df in kept[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    rows = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in kept[:-1]]
    model = ordinal.train(docs, ordinal.grades_of(spark.read.parquet(f"{folder}/labels.parquet")))
    features = ordinal.Features()
    score = np.array([float(model.weights[features.of_text(t)].sum(dtype=np.float64)) for _, t in rows[0]])
    cores = lambda t: [x for w in set((t or "").split()) if (x := w.strip(ordinal.PUNCTUATION).lower())]
    rated = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = {x for i, t in rows[0] if i in rated for x in cores(t)}
    known = [sum(x in seen for x in cores(t)) >= ordinal.EVIDENCE * len(cores(t)) > 0 for _, t in rows[0]]
    assert sorted(i for (i, _), p, k in zip(rows[0], model.tails(score)[:, -1], known) if k and p >= ordinal.KEEP) == sorted(i for i, _ in rows[1])
    assert not all(known)
    left = {i for i, _ in rows[1]}
    assert not left & set(range(3000, 3060)) and left >= set(range(4000, 4060))  # held-out ones too
    groups = brute_components(rows[1])
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_report(rows[2], items) if r[-1]}
    assert bad >= set(range(2000, 2006)) and sorted(i for i, _ in rows[3]) == sorted(i for i, _ in rows[2] if i not in bad)
    enc = tik()
    want = []
    for i, t in rows[3]:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, kept[-1].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_stages_decide_by_row(spark, tmp_path):
    """Null ids, repeated ids and repeated rows; a benchmark item without an id."""
    rng = random.Random(3)
    a, b, c, d, e, f, item, other = (words(rng, 30, 5000) for _ in range(8))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, d), (2, e), (3, b), (None, e), (4, None), (5, "")]
    got = corpus_pipeline.near_duplicate(spark, frame(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (1, c), (2, d), (2, e), (3, b), (4, None), (5, "")], key=str)
    spark.createDataFrame([(None, item), (7, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, "x " + item), (1, b), (1, item + " y"), (2, c + " " + other), (2, c), (3, f), (3, f), (None, other)]
    got = corpus_pipeline.decontaminated(spark, frame(spark, rows), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (1, b), (2, c), (3, f), (3, f)], key=str)
