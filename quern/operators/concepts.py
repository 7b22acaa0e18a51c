"""Concepts of texts: phrases and frequent words, their graph, and the matching of questions to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import graph

# Phrases of capitalised words.
PHRASES = [r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", r"\b[A-Z]{2,}(?: [A-Z]{2,})*\b"]


def noun_concepts(df: DataFrame, key: str, text: str = "text", most: int = 20, least: int = 2) -> DataFrame:
    """(key, concept, n): phrases of at most five words, half of them stop words at most, and the most frequent words."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHRASES])
    p = df.select(key, F.explode(found).alias("c")).withColumn("w", tx.words(F.lower("c")))
    stop = F.size(F.filter("w", lambda w: w.isin(tx.STOP_WORDS)))
    p = p.where((F.size("w") <= 5) & (2 * stop <= F.size("w"))).groupBy(key, F.lower("c").alias("concept")).agg(F.count("*").alias("n"))
    w = df.select(key, F.explode(tx.index_tokens(F.col(text))).alias("concept")).groupBy(key, "concept").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = w.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "concept"))).where(F.col("rn") <= most).drop("rn")
    return p.unionByName(top).groupBy(key, "concept").agg(F.max("n").alias("n"))


def related(relations: DataFrame, k: int = 5) -> DataFrame:
    """(name, other, confidence, place): each concept's k surest relations, either way."""
    both = relations.select("name", "other", "confidence").union(relations.select("other", "name", "confidence"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("confidence"), "other")).cast("long")).where(F.col("place") <= k)


def rank(found: DataFrame, relations: DataFrame, documents: int, least: float = 0.1) -> DataFrame:
    """(name, degree, rank, score): .4 degree of the others + .4 PageRank of the highest + .2 tanh(ln(N / df) / 5), .1 at least.

    found: (name, chunks); relations: (name, other, confidence), taken both ways.
    """
    edges = relations.select(F.col("name").alias("source"), F.col("other").alias("target"), "confidence")
    both = edges.union(edges.select("target", "source", "confidence"))
    degree = both.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("degree"))
    ranks = graph.pagerank(found.select(F.col("name").alias("id")), both).withColumnRenamed("node", "name")
    n = found.count()
    top = ranks.agg(F.max("rank").alias("top"))
    j = found.join(degree, "name", "left").join(ranks, "name").join(F.broadcast(top))
    share = F.coalesce("degree", F.lit(0)) / F.lit(max(1, n - 1))
    score = 0.4 * share + 0.4 * F.col("rank") / F.col("top") + 0.2 * F.tanh(F.log(F.lit(float(documents)) / F.col("chunks")) / 5)
    return j.select("name", F.coalesce("degree", F.lit(0)).alias("degree"), F.round("rank", 8).alias("rank"), F.round(score, 6).alias("score")).where(F.col("score") >= least)


def match(question: str, concepts: DataFrame, k: int = 20) -> DataFrame:
    """(name, score): .5 for a concept that is a word of the question, .3 for one within two edits, and .2 of its own score."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(question.lower().split())])
    low = F.lower("name")
    exact, near = F.array_contains(asked, low), F.exists(asked, lambda w: F.levenshtein(low, w) <= 2)
    hit = concepts.where(exact | near)
    return hit.select("name", F.round(F.when(exact, 0.5).otherwise(0.0) + F.when(near, 0.3).otherwise(0.0) + 0.2 * F.col("score"), 6).alias("score")).orderBy(F.desc("score"), "name").limit(k)


def refine(seeds: DataFrame, relations: DataFrame, counts: DataFrame, rounds: int = 3, most: int = 5) -> DataFrame:
    """(name, round, score): up to `rounds` expansions by the `most` best related concepts, (ln f + 1)(1 + .5 links to what is known)."""
    both = relations.select("name", "other").union(relations.select("other", "name"))
    known = seeds.select("name", F.lit(0).alias("round"), F.lit(1.0).alias("score"))
    for r in range(1, rounds + 1):
        links = both.join(F.broadcast(known.select("name")), "name").groupBy(F.col("other").alias("name")).agg(F.count("*").alias("links")).join(F.broadcast(known.select("name")), "name", "left_anti")
        best = links.join(counts, "name").select("name", F.lit(r).alias("round"), F.round((F.log("chunks") + 1) * (1 + 0.5 * F.col("links")), 6).alias("score"))
        new = best.orderBy(F.desc("score"), "name").limit(most)
        rows = [tuple(x) for x in new.collect()]  # five rows at most
        if not rows:
            break
        known = known.union(known.sparkSession.createDataFrame(rows, "name string, round int, score double"))
    return known


def deepen(seeds: DataFrame, relations: DataFrame, mentions: DataFrame, depth: int = 3, chunks: int = 50, ratio: float = 0.7, least: int = 5) -> DataFrame:
    """(depth, concepts, chunks): what each step of a search finds, until it has enough chunks, or enough for its concepts."""
    both = relations.select("name", "other").union(relations.select("other", "name"))
    now, steps = seeds.select("name").distinct(), []
    for d in range(depth):
        n = now.count()
        c = mentions.join(F.broadcast(now), "name", "left_semi").select("doc_id", "at").distinct().count()
        steps.append((d, n, c))
        if c >= chunks or (d and c >= least and c / max(1, n) >= ratio):
            break
        now = graph.stage(now.union(both.join(F.broadcast(now), "name").select("other")).distinct(), "concepts")
    return seeds.sparkSession.createDataFrame(steps, "depth int, concepts long, chunks long")
