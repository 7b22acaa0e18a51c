"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score): one weight vector over hashed text features is shared by all
grades, and the thresholds are kept in order. A document gets its expected grade and the probability of
each tail; selection asks for a tail probability, and that the model knows the text: `evidence` is the share
of a text's distinct words that the rated sample has, and a text with less than EVIDENCE isn't kept, whatever
its score; gibberish has no word that speaks against it, but none that was ever rated good either.

Features are sets, of the whole text: each distinct word in lower case without its punctuation and its first letters, each
distinct run of punctuation at a word's end, the share of words in capitals, and that of words like the one before.

Defined cases: a null or empty text, or one without words, has no features, the score 0, evidence 0, and isn't
kept; rows without a grade are not fitted; several ratings of a document count once for each grade; where all ratings of the
sample are one grade, that grade is certain; without any rating every document is kept; ties at the tail
probability are kept; an empty table gives an empty table; columns of the input that bear the name of an output
column are replaced, all others stay; a very long text is read whole, in one worker.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import add_columns
from quern.runtime import discard, stage

#: Hash buckets of features; bounds on the labelled rows that are fitted and on the bytes of their texts; passes over them.
BITS, SAMPLE, SAMPLE_BYTES, PASSES = 20, 12_000, 128 << 20, 800
#: Likelihood ratio (chi squared) from which a feature takes part, so that the many words that say nothing add no noise.
TELLING = 20.0
#: Hash buckets of the sample's words (a table of 2 MB), and the share of a text's words that must be among them.
WORD_BITS, EVIDENCE = 24, 0.1
#: Lengths of the beginnings of words that are features too, for words that share a stem.
STEMS = (4, 5)
#: The tail probability from which a document is kept; words whose features a task remembers.
KEEP, WORDS = 0.8, 50_000
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Features:
    """Features of words, remembered for a bounded number of words.

    With weights, features of weight 0 are left out: they add nothing to a score, and most words have no other.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.known: dict[str, tuple] = {}
        self.weights = weights

    def of_word(self, word: str) -> tuple[tuple, int]:
        """The word's features and its own place among 2^WORD_BITS; -1 if it is punctuation alone."""
        core = word.strip(PUNCTUATION)
        tail = word[len(word.rstrip(PUNCTUATION)) :]
        place = lambda s: xxhash.xxh3_64_intdigest(s.encode()) >> (64 - BITS)
        low = core.lower()
        stem = [place("\3" + low[:n]) for n in STEMS if len(low) > n]
        every = (*([place(low)] if core else []), *stem, *([place("\0" + tail)] if tail else []))
        if self.weights is not None:
            every = tuple(x for x in every if self.weights[x])
        return every, xxhash.xxh3_64_intdigest(low.encode()) >> (64 - WORD_BITS) if core else -1

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's features, and the places of its distinct words."""
        if len(self.known) > WORDS:
            self.known.clear()
        every = (text or "").split()
        words, out, places, known = set(every), set(), [], self.known
        for w in words:
            if (f := known.get(w)) is None:
                f = known[w] = self.of_word(w)
            if f[0]:
                out.update(f[0])
            places.append(f[1])
        if words:
            capitals = sum(map(str.isupper, words)) * 8 // len(words)
            out.add(xxhash.xxh3_64_intdigest(b"\1%d" % capitals) >> (64 - BITS))
            repeats = sum(map(eq, every, every[1:])) * 8 // len(every)
            out.add(xxhash.xxh3_64_intdigest(b"\2%d" % repeats) >> (64 - BITS))
        places = np.array(places, np.int32)
        return np.fromiter(out, np.int32, len(out)), places[places >= 0]

    def of_text(self, text: str | None) -> np.ndarray:
        return self.read(text)[0]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    seen: np.ndarray | None = None  # bits of the sample's words; None: evidence isn't asked for

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 - sigmoid(self.thresholds[None, :] - score[:, None])

    def evidence(self, places: np.ndarray) -> float:
        """The share of words, by place, that the sample has."""
        if not len(places):
            return 0.0
        return 1.0 if self.seen is None else float((self.seen[places >> 3] >> (places & 7) & 1).mean())


def telling(features: list[np.ndarray], grades: np.ndarray, least: float = TELLING) -> np.ndarray:
    """Which buckets speak for a low grade: the likelihood ratio of "below k" given the feature, for the best k.

    Features that speak for a high grade are words common enough to stand in any long text; summed over a
    long text they would outweigh any fault in it. Counted in blocks of rows, so that memory is small.
    """
    ks = range(1, int(grades.max(initial=0)) + 1)
    have, parts = np.zeros(1 << BITS, np.int32), {k: np.zeros(1 << BITS, np.int32) for k in ks}
    for i in range(0, len(features), 512):
        some, own = features[i : i + 512], grades[i : i + 512]
        have += np.bincount(np.concatenate(some), minlength=1 << BITS).astype(np.int32)
        for k in ks:
            if low := [f for f, g in zip(some, own) if g < k]:
                parts[k] += np.bincount(np.concatenate(low), minlength=1 << BITS).astype(np.int32)
    best = np.zeros(1 << BITS)
    for k, part in parts.items():
        share, own = (grades < k).mean().clip(1e-6, 1 - 1e-6), np.divide(part, have, out=np.zeros(1 << BITS), where=have > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(part > 0, part * np.log(own / share), 0) + np.where(part < have, (have - part) * np.log((1 - own) / (1 - share)), 0)
        best = np.maximum(best, np.where(own > share, 2 * ratio, 0))
    return best >= least


def cuts_of(theta: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and the logarithms of the gaps between them."""
    return theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])


def loss(weights: np.ndarray, theta: np.ndarray, index: np.ndarray, rows: np.ndarray, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood with its penalty, and its gradients by the weights and by theta.

    Features are given as pairs: feature index[i] is in row rows[i].
    """
    levels, n = len(theta), len(grades)
    cuts = np.concatenate([[-np.inf], cuts_of(theta), [np.inf]])
    score = np.bincount(rows, weights[index], minlength=n)
    upper, lower = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
    upper[grades == levels], lower[grades == 0] = 1.0, 0.0
    pull = 1 - upper - lower  # of -log p by the score
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = np.zeros(levels + 2)
    np.add.at(by_cut, grades + 1, -du)
    np.add.at(by_cut, grades, dl)
    by_cut = by_cut[1:-1]
    by_theta = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * np.exp(theta[k]) for k in range(1, levels)]]) / n
    by_weight = np.bincount(index, pull[rows], minlength=len(weights)) / n + penalty * weights
    return float(-np.log(p).mean() + penalty / 2 * (weights @ weights)), by_weight, by_theta


def fit(features: list[np.ndarray], grades: np.ndarray, levels: int | None = None, penalty: float = 1e-5, rate: float = 0.1) -> Ordinal:
    """Maximum likelihood by Adam over all rows and the telling features, with a small squared penalty.

    levels: the highest grade there may be (default: that of the sample).
    """
    told = telling(features, grades)
    places = np.cumsum(told) - 1
    features = [places[f[told[f]]] for f in features]
    levels = max(1, int(grades.max(initial=0)) if levels is None else levels)
    every = np.zeros(1 << BITS, np.float32)
    if len(set(grades.tolist())) < 2:  # no grades: all are kept; one grade: it is certain
        only = int(grades[0]) if len(grades) else levels
        return Ordinal(every, np.where(np.arange(1, levels + 1) <= only, -40.0, 40.0))
    weights = np.zeros(int(told.sum()), np.float64)
    index = np.concatenate([*features, np.zeros(0, np.int64)])
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    share = np.array([(grades >= k).mean() for k in range(1, levels + 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    state = [[weights, np.zeros_like(weights), np.zeros_like(weights)], [theta, np.zeros_like(theta), np.zeros_like(theta)]]
    for step in range(1, PASSES + 1):
        _, by_weight, by_theta = loss(weights, theta, index, rows, grades, penalty)
        for (x, m, v), g in zip(state, (by_weight, by_theta)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    every[told] = weights
    return Ordinal(every, cuts_of(theta))


def sampled(docs: DataFrame, grades: DataFrame, key: str, text: str, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[list, np.ndarray, np.ndarray | None]:
    """Features and grades of at most `rows` rated documents, those of the least hashes, as far as their texts have
    at most `size` bytes together (one document at least); and the bits of their words."""
    rated = grades.where("grade is not null").select(F.col(key).alias("k"), "grade").distinct().orderBy(F.xxhash64("k", F.lit(11)), "k", "grade").limit(rows)
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = own.select("k", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(rated), "k").distinct()
    chosen, total = [], 0
    for r in sizes.orderBy(F.xxhash64("k", F.lit(11)), "k", "h", "grade").limit(rows).collect():
        total += r["n"]
        if chosen and total > size:
            break
        chosen.append((r["k"], r["h"], r["grade"]))
    if not chosen:
        return [], np.zeros(0, np.int64), None
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", own.schema["k"].dataType), T.StructField("h", T.LongType()), T.StructField("grade", T.IntegerType())]))
    joined = own.join(F.broadcast(wanted.select("k", "h").distinct()), ["k", "h"])

    def start():
        f = Features()

        def make(texts: list) -> list:
            every = list(map(f.read, texts))
            return [pa.array([a.tobytes() for a, _ in every], pa.binary()), pa.array([p for _, p in every], pa.list_(pa.int32()))]

        return make

    each = add_columns(joined, "text", [("features", T.BinaryType()), ("places", T.ArrayType(T.IntegerType()))], start, keep=["k", "h"])
    made = stage(each.dropDuplicates(["k", "h"]), "sample")  # texts are read where they lie; only what is made of them is shuffled
    place = made.select(F.explode("places").alias("p")).select(F.floor(F.col("p") / 32768).alias("block"), (F.col("p") % 32768).cast("long").alias("bit"))
    seen = np.zeros(1 << (WORD_BITS - 3), np.uint8)
    for r in place.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        seen[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    got = {(r["k"], r["h"]): np.frombuffer(bytes(r["features"]), np.int32) for r in made.select("k", "h", "features").toLocalIterator()}
    every = sorted(chosen, key=lambda r: (r[0], r[2], r[1]))
    discard(made)
    return [got[k, h] for k, h, _ in every], np.array([g for _, _, g in every], np.int64), seen


def grades_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Grade 0: low quality; 1: good but toxic; 2: good and clean. No quality: no grade; no toxicity: clean."""
    grade = F.when(F.col("quality").isNull(), None).when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.select(key, grade.cast("int").alias("grade"))


#: The highest grade of grades_of().
LEVELS = 2


def train(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE, levels: int = LEVELS) -> Ordinal:
    features, y, seen = sampled(docs, grades, key, text, rows)
    model = fit(features, y, levels)
    model.seen = seen
    return model


def classify(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None, least: float = KEEP) -> DataFrame:
    """Adds score, expected_grade, tail_probability (of the highest grade), evidence and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB of weights and 2 MB of words' bits whatever the input

    def start():
        m = shared.value
        f = Features(m.weights)

        def make(texts: list) -> list:
            every = list(map(f.read, texts))
            score = np.array([float(m.weights[x].sum(dtype=np.float64)) for x, _ in every])
            known = np.array([m.evidence(p) for _, p in every])
            tails = m.tails(score)
            return [pa.array(score), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(known), pa.array((tails[:, -1] >= least) & (known >= EVIDENCE if m.seen is not None else True))]

        return make

    new = [("score", T.DoubleType()), ("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("evidence", T.DoubleType()), ("kept", T.BooleanType())]
    return add_columns(docs, text, new, start, keep)
