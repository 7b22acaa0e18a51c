"""Whitening against the covariance matrix itself, with exact whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def fixture():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, s) for s in (3, 2, 1.5, 1, 0.5, 0.2)], 0) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1], 1) for i in range(90)]  # repeats, one id of which comes twice
    rows += [(1000, rows[5][1], 1), (2000, None, 0), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] + [0.0] * 5, 0)]
    rows += [(2004, [], 0), (2005, [1.5, -0.0], 0), (None, [0.25] * 6, 0)]
    return rows


def expected(rows, most=4):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    kept = [(i, tuple(math.floor(float(np.float32(c)) * 256) for c in v) + (0,) * (width - len(v))) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({x for _, x in kept})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    exact = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fitted), n**3) for j in range(width)] for i in range(width)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in exact]))
    order = np.argsort(-values)[:most]
    return kept, n, sums, values[order], vectors[:, order].T, values.sum()


def check(got, rows):
    kept, n, sums, values, vectors, trace = expected(rows)
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    assert len(got) == len(kept) * len(values)
    signs = {}
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums)]
        own = by_row[i, sum(a * a for a in d)]
        for k, (e, v) in enumerate(zip(values, vectors), 1):
            want = float(np.array([a / n for a in d]) @ v / math.sqrt(e))
            for r in (r for r in own if r["component"] == k):
                if abs(want) > 1e-3:
                    signs.setdefault(k, np.sign(want * r["whitened"]))
                assert abs(r["whitened"] * signs.get(k, 1) - want) < 1e-7 and r["n"] == n and abs(r["explained"] - e / trace) < 1e-9
                assert r["identity_error"] < 1e-9 and int(r["deviation_exact"]) == r["deviation"]


def test_against_covariance(spark):
    rows = fixture()
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(11)).collect(), rows)


def test_merge_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    fitted = whitening.distinct_vectors(df, "embedding", 6).repartition(9)
    model = whitening.fit(fitted, 6)
    _, n, sums, values, vectors, _ = expected(rows)
    assert (model.centre.n, model.centre.sums) == (n, sums) and np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(np.abs((model.vectors * vectors).sum(axis=1)), 1, atol=1e-12)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows)


def test_wide_numbers(spark):
    rows = [(i, [float(2**40 + i * i), -float(i) * 2**33, float(i % 3)], 0) for i in range(40)]
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), most=2).collect()
    x = [[math.floor(c * 256) for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((40 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    for r in made:
        assert int(r["deviation_exact"]) == want[r["vec_id"]] and r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None)
    assert whitening.whole(whitening.pa.array([[1e300, -1e300]]), 2)[1].tolist() == [[2**63 - 1, -(2**63)]]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(2, [1.0, 2.0], 0), (3, [1.0, 2.0], 0)], [(1, [0.5], 0), (2, [1.5], 0)]])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("x", F.lit(None).cast("string"))
    got = whitening.whiten(df).collect()
    kept = [r for r in rows if r[1]]
    assert len(got) == len(kept) * min(4, max((len(v) for _, v, _ in kept), default=0))
    for r in got:
        if len({tuple(v) for _, v, _ in kept}) == 1:
            assert r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
        else:
            assert abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == 1.0
