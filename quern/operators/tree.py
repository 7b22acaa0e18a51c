"""Summary trees: each document's chunks, merged five by five up to one root."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def keywords(words: Column, keep: int) -> Column:
    """The `keep` most frequent of some words, of equals the least, in order; words of a row meet in that row, so nothing is shuffled."""
    top = F.sort_array(F.transform(F.slice(F.sort_array(tx.counted(words)), 1, keep), lambda x: x["word"]))
    return F.coalesce(top, F.array().cast("array<string>"))


def leaves(chunks: DataFrame, keep: int = 5) -> DataFrame:
    """Level 0 of rows (doc_id, at, start_offset, content): with the chunk's most frequent words as keywords."""
    end = F.col("start_offset") + F.length("content")
    top = keywords(tx.frequent_tokens(F.col("content")), keep)
    return chunks.select("doc_id", F.lit(0).alias("level"), "at", F.lit(0).cast("long").alias("children"), "content", top.alias("keywords"), F.col("start_offset").alias("start"), end.alias("end"))


def height(last: Column, merge: int) -> Column:
    """The level of the root of a document whose last chunk is `last`: each level has a merge-th of the places of the one below."""
    powers = F.array(*[F.lit(merge**i) for i in range(1 + math.floor(63 / math.log2(merge) - 1e-9))])
    return F.size(F.filter(powers, lambda p: p <= last))


def build(chunks: DataFrame, merge: int = 5, keep: int = 10) -> DataFrame:
    """(doc_id, level, at, children, content, keywords, start, end): nodes of all levels; a document's last level is its root.

    A node joins its children's contents by a blank line and holds their first `keep` keywords in order; its
    parent is node at / merge of the next level. A document's chunks are shuffled once and meet in a row no larger than about
    its root; the nodes above are parts of that row.
    """
    low = leaves(chunks)
    row = F.struct("at", "content", "keywords", "start", "end")
    held = low.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    even = F.forall(F.transform("c", lambda x, i: x["at"] == i), lambda x: x)  # places 0, 1, 2, ..., each once
    held = held.select("doc_id", "c", even.alias("even"), F.element_at("c", -1)["at"].alias("last"))
    width = lambda level: F.pow(F.lit(float(merge)), level).cast("long")
    places = F.flatten(F.transform(F.sequence(F.lit(1), height(F.col("last"), merge)), lambda v: F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / width(v))), lambda a: F.struct(v.alias("level"), a.alias("at")))))
    nodes = held.where("last > 0").select("doc_id", "c", "even", F.explode(places).alias("p")).withColumn("w", width(F.col("p.level")))
    begin = F.col("p.at") * F.col("w")
    part = F.when(F.col("even"), F.slice("c", (begin + 1).cast("int"), F.col("w").cast("int"))).otherwise(F.filter("c", lambda x: (x["at"] >= begin) & (x["at"] < begin + F.col("w"))))
    below = F.size(F.array_distinct(F.transform("part", lambda x: F.floor(x["at"] * merge / F.col("w")))))
    nodes = nodes.select("doc_id", "p", "w", part.alias("part")).where(F.size("part") > 0)
    made = nodes.select(
        "doc_id", F.col("p.level").alias("level"), F.col("p.at").alias("at"), F.when(F.col("p.level") == 1, F.size("part")).otherwise(below).cast("long").alias("children"),
        F.array_join(F.transform("part", lambda x: x["content"]), "\n\n").alias("content"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform("part", lambda x: x["keywords"])))), 1, keep).alias("keywords"),
        F.array_min(F.transform("part", lambda x: x["start"])).alias("start"), F.array_max(F.transform("part", lambda x: x["end"])).alias("end"),
    )
    return low.unionByName(made)


def shape(chunks: DataFrame, merge: int = 5) -> DataFrame:
    """(doc_id, level, at): the nodes that build() makes, without what they hold."""
    low = chunks.select("doc_id", "at")
    last = low.groupBy("doc_id").agg(F.max("at").alias("last"))
    up = low.join(last, "doc_id").where("last > 0").select("doc_id", "at", F.explode(F.sequence(F.lit(1), height(F.col("last"), merge))).alias("level"))
    up = up.select("doc_id", "level", F.floor(F.col("at") / F.pow(F.lit(float(merge)), F.col("level"))).alias("at")).distinct()
    return low.select("doc_id", F.lit(0).alias("level"), "at").unionByName(up)


def search(nodes: DataFrame, words: list[str], k: int = 10, least: float = 0.1) -> DataFrame:
    """(doc_id, level, at, score): 1 for each asked word among the keywords, twice the share of them that the content has, .5 / (level + 1)."""
    asked = F.array(*[F.lit(w) for w in words])
    hits, found = F.size(F.array_intersect("keywords", asked)), F.size(F.array_intersect(tx.words(F.lower("content")), asked))
    known = F.when(hits + found > 0, 0.5 / (F.col("level") + 1)).otherwise(0.0)
    score = F.round(hits + 2.0 * found / len(words) + known, 6)
    return nodes.select("doc_id", "level", "at", score.alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), "doc_id", "level", "at").limit(k)


def ancestors(nodes: DataFrame, merge: int = 5) -> DataFrame:
    """(doc_id, at, level, ancestor) of every leaf: its place divided by merge as often as the level says."""
    up = nodes.where("level > 0").select("doc_id", "level", F.col("at").alias("ancestor"))
    leaf = nodes.where("level = 0").select("doc_id", "at")
    steps = nodes.agg(F.max("level")).collect()[0][0] or 0
    if not steps:
        return leaf.select("doc_id", "at", F.lit(0).alias("level"), F.col("at").alias("ancestor")).limit(0)
    each = leaf.select("doc_id", "at", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("level")).withColumn("ancestor", F.floor(F.col("at") / F.pow(F.lit(float(merge)), F.col("level"))))
    return each.join(up, ["doc_id", "level", "ancestor"]).select("doc_id", "at", "level", "ancestor")
