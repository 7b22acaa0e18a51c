"""Chunks by meaning: breaks where neighbouring sentences differ most, and the best segmentation under size bounds.

Laws: a null text has no chunk, a text of one sentence is one; every sentence is in exactly one chunk, a short tail joins
the chunk before; ties at a threshold are no breaks; of equal segmentations the one with the longest last chunks counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of distinct words; 0 if one is empty."""
    n = F.size(a) * F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.sqrt(n.cast("double"))).otherwise(0.0)


def distances(sets: Column, ahead: int = 1) -> Column:
    """1 - cosine of each sentence with the one `ahead` after it."""
    n = F.greatest(F.size(sets) - ahead, F.lit(0))
    return F.zip_with(F.slice(sets, F.lit(1), n), F.slice(sets, F.lit(1 + ahead), n), lambda a, b: F.round(1 - set_cosine(a, b), 9))


def threshold(d: Column, how: str, amount: float) -> Column:
    """percentile: the value at floor(n amount / 100) of the sorted ones; deviation: mean + amount deviations; absolute: amount."""
    n = F.size(d)
    if how == "percentile":
        return F.when(n > 0, F.get(F.array_sort(d), F.least(F.floor(n * amount / 100.0).cast("int"), n - 1)))
    if how == "deviation":
        mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
        square = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / n
        return F.when(n > 0, F.round(mean + amount * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 9))
    if how == "absolute":
        return F.lit(float(amount))
    raise ValueError(f"{how} is none of percentile, deviation, absolute")


def kept_ends(ends: Column, least: int) -> Column:
    """Ends of chunks of at least `least` sentences: shorter ones go on into the next, a short tail joins the one before."""
    none = F.array().cast("array<int>")
    last = lambda cuts: F.coalesce(F.get(cuts, F.size(cuts) - 1), F.lit(0))

    def whole(ends: Column, cuts: Column) -> Column:
        end = F.get(ends, F.size(ends) - 1)
        return F.when(F.size(cuts) == 0, F.array(end)).when(last(cuts) == end, cuts).otherwise(F.array_append(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))), end))

    fold = lambda ends: F.aggregate(ends, none, lambda cuts, e: F.when(e - last(cuts) >= least, F.array_append(cuts, e)).otherwise(cuts))
    return tx.let(ends, lambda ends: tx.let(fold(ends), lambda cuts: whole(ends, cuts)))


def semantic(docs: DataFrame, key: str = "doc_id", text: str = "text", ahead: int = 1, how: str = "percentile", amount: float = 95.0, least: int = 1, most: int = 0) -> DataFrame:
    """(key, at, first, end, content): runs of sentences parted where the distance to the sentence `ahead` is above the threshold.

    least and most: sentences of a chunk; 0: no bound. All of a document's work is done on its own row, in the JVM.
    """
    s = docs.select(F.col(key).alias("key"), tx.sentences(F.col(text), 0).alias("sentences")).where(F.size("sentences") > 0)
    sets = F.transform("sentences", lambda x: F.array_distinct(tx.words(F.lower(x))))
    after = lambda d, limit: F.filter(F.transform(d, lambda x, i: F.when(x > limit, i + 1)), lambda i: i.isNotNull())
    breaks = tx.let(tx.let(sets, lambda x: distances(x, ahead)), lambda d: tx.let(threshold(d, how, amount), lambda limit: after(d, limit)))
    span = lambda cuts: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(cuts, F.lit(1), F.size(cuts) - 1)), cuts, lambda a, e: F.struct(a.alias("first"), e.alias("end")))
    parts = tx.let(kept_ends(F.array_append(breaks, F.size("sentences")), least), span)
    if most:
        parts = F.flatten(F.transform(parts, lambda x: F.transform(F.sequence(x["first"], x["end"] - 1, F.lit(most)), lambda a: F.struct(a.alias("first"), F.least(a + most, x["end"]).alias("end")))))
    cut = s.withColumn("parts", parts)
    each = cut.select("key", "sentences", F.posexplode("parts").alias("at", "x"))
    return each.select(F.col("key").alias(key), "at", "x.first", "x.end", F.array_join(F.slice("sentences", F.col("x.first") + 1, F.col("x.end") - F.col("x.first")), " ").alias("content"))


def optimal_cuts(gains: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of len(gains) + 1 sentences with the greatest sum of gains inside chunks, of least to most sentences each.

    gains[i] is what keeping sentences i and i + 1 together is worth. Prefix sums make a chunk's worth a difference, so
    memory is linear and each sentence looks at `most - least` starts. Fewer than `least` sentences are one chunk.
    """
    n = len(gains) + 1
    if n <= least:
        return [n]
    total = np.concatenate([[0.0], np.cumsum(gains)])
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    best[0] = 0.0
    for e in range(least, n + 1):
        start = max(0, e - most)
        worth = best[start : e - least + 1] + total[e - 1] - total[start : e - least + 1]
        at = int(np.argmax(worth))
        best[e], back[e] = worth[at], start + at
    cuts = [n]
    while back[cuts[-1]] > 0:
        cuts.append(int(back[cuts[-1]]))
    return cuts[::-1]


def coherent(least: int = 2, most: int = 12, paragraph: float = 0.25) -> Callable[[str], list[tuple[int, int]]]:
    """A cutter for chunks.chunk: the segmentation with the most coherence inside chunks, above the text's mean.

    A pair of neighbouring sentences gains its cosine less the mean of all; one that a paragraph's end parts, `paragraph` less.
    Any number of sentences from `least` on can be dealt out only if most >= 2 least - 1.
    """
    if least < 1 or most < 2 * least - 1:
        raise ValueError("most must be at least 2 least - 1")

    def cut(text: str) -> list[tuple[int, int]]:
        bounds = [0, *[m.end() for m in re.finditer(r"[.!?]+\s+|\n\s*\n", text)]]
        if bounds[-1] != len(text):
            bounds.append(len(text))
        spans = list(zip(bounds, bounds[1:]))
        if not spans:
            return []
        sets = [set(text[a:b].lower().split()) for a, b in spans]
        alike = np.array([len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0 for a, b in zip(sets, sets[1:])])
        parted = np.array([bool(re.search(r"\n\s*\n\s*$", text[a:b])) for a, b in spans[:-1]], float)
        ends = optimal_cuts(alike - (alike.mean() if len(alike) else 0) - paragraph * parted, least, most)
        return [(spans[a][0], spans[b - 1][1]) for a, b in zip([0, *ends], ends)]

    return cut
