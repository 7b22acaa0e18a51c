"""The graph of a corpus: global entities and their co-occurrence, from mentions (doc, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def global_entities(mentions: DataFrame) -> DataFrame:
    """(name, documents, mentions, importance): counted by document first, so that a frequent name is many small rows."""
    per = mentions.groupBy("name", "doc").agg(F.count("*").alias("n"))
    g = per.groupBy("name").agg(F.count("*").alias("documents"), F.sum("n").alias("mentions"))
    score = (0.4 * (F.log("documents") + 1) + 0.3 * (F.log("mentions") + 1) + 0.3 * F.col("documents")) / 3
    return g.withColumn("importance", F.round(score, 6))


def co_occurrences(mentions: DataFrame) -> DataFrame:
    """(source, target, documents, confidence) of names that share documents: .7, and .1 for each further one, at most 1."""
    d = mentions.select("doc", F.col("name").alias("source")).distinct()
    pairs = d.join(d.withColumnRenamed("source", "target"), "doc").where("source < target").groupBy("source", "target").agg(F.count("*").alias("documents"))
    return pairs.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.7 + 0.1 * (F.col("documents") - 1)), 6))


def statistics(mentions: DataFrame) -> DataFrame:
    """(entities, relations, mean_connections, density, quality): quality .3 connections (of ten), .3 confidence, .4 entities a document."""
    n = mentions.agg(F.countDistinct("name").alias("entities"), F.countDistinct("doc").alias("docs"))
    e = co_occurrences(mentions).agg(F.count("*").alias("relations"), F.avg("confidence").alias("c"))
    mean = 2 * F.col("relations") / F.col("entities")
    one = F.lit(1.0)
    quality = 0.3 * F.least(one, mean / 10) + 0.3 * F.col("c") + 0.4 * F.least(one, F.col("entities") / F.col("docs"))
    return n.join(e).select("entities", "relations", F.round(mean, 6).alias("mean_connections"), F.round(mean / (F.col("entities") - 1), 6).alias("density"), F.round(quality, 6).alias("quality"))


def clusters(docs: DataFrame, patterns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(concept, mentions, documents) of phrases that any pattern finds, in lower case."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    each = docs.select(key, F.explode(found).alias("c")).groupBy(F.lower(F.trim("c")).alias("concept"), key).agg(F.count("*").alias("n"))
    return each.groupBy("concept").agg(F.sum("n").alias("mentions"), F.count("*").alias("documents"))
