"""Extractive summaries: sentences scored by place, length, words in common, names and numbers; the best within a budget.

Laws: a null text, or one without a sentence of more than five bytes, has no summary; equal scores stand in the text's order; where no
sentence fits the budget the best one is taken; a single sentence that is too long is cut before a word, and ends in "...".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

ENDS = " \\t\\n\\r\\f"


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ?, trimmed, of more than five bytes."""
    parts = F.split(F.regexp_replace(text, "([.!?])", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, f"^[{ENDS}]+|[{ENDS}]+$", "")), lambda s: F.octet_length(s) > 5)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, total, s, score) of every sentence; at counts from 1."""
    each = docs.select(F.col(key).alias("key"), sentences(F.col(text)).alias("every")).select("key", F.size("every").alias("total"), F.posexplode("every").alias("p", "s"))
    each = each.select("key", (F.col("p") + 1).alias("at"), "total", "s", tx.words(F.col("s")).alias("w")).withColumn("n", F.size("w"))
    cleaned = F.transform("w", lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    words = each.select("key", "at", F.explode(cleaned).alias("word")).where((F.col("word") != "") & ~F.col("word").isin(tx.STOP_WORDS))
    often = words.withColumn("often", F.count("*").over(Window.partitionBy("key", "word"))).groupBy("key", "at").agg((F.sum("often") / F.count("*")).alias("often"))
    names = F.size(F.filter("w", lambda w: w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 2) & ~F.lower(w).isin(tx.STOP_WORDS)))
    numbers = F.size(F.filter("w", lambda w: w.rlike(r"\p{N}")))
    place = F.when(F.col("at") == 1, 2.0).when(F.col("at") == F.col("total"), 1.5).otherwise(1 - 0.5 * (F.col("at") - 1) / F.col("total"))
    size = F.when(F.col("n") < 5, 0.3).when(F.col("n") > 40, 0.5).when(F.col("n").between(10, 25), 1.0).otherwise(0.7)
    common = F.least(F.coalesce("often", F.lit(0.0)) / 3, F.lit(1.0))
    score = 0.3 * place + 0.2 * size + 0.3 * common + 0.1 * names / F.greatest("n", F.lit(1)) + 0.1 * F.least(0.3 * numbers, F.lit(1.0))
    return each.join(often, ["key", "at"], "left").select(F.col("key").alias(key), "at", "total", "s", F.round(score, 6).alias("score"))


def ordered(rows: DataFrame, key: str) -> DataFrame:
    """(key, x): the sentences of each text, the best first."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "at", "s", F.octet_length("s").alias("n"))))
    return rows.groupBy(key).agg(best.alias("x"))


def in_order(picked: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(picked, lambda y: F.struct(y["at"].alias("at"), y["s"].alias("s")))), lambda y: y["s"]), " ")


def best_sentences(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary): the n best sentences in the text's order."""
    return ordered(scored(docs, key, text), key).select(key, in_order(F.slice("x", 1, n)).alias("summary"))


def summarize(docs: DataFrame, most: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, summary): the best sentences that fit `most` bytes, in the text's order.

    Sentences are tried from the best on, each that still fits is taken, and the search ends once nine tenths are full.
    """
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("taken"), F.lit(False).alias("full"))

    def step(state: Column, y: Column) -> Column:
        fits = state["held"] + y["n"] < most
        held = F.when(fits, state["held"] + y["n"] + 1).otherwise(state["held"])
        return F.when(state["full"], state).otherwise(F.struct(held.alias("held"), F.when(fits, F.array_append(state["taken"], y["at"])).otherwise(state["taken"]).alias("taken"), (held >= most * 90 // 100).alias("full")))

    x = ordered(scored(docs, key, text), key).withColumn("taken", F.aggregate("x", start, step)["taken"])
    picked = F.when(F.size("taken") == 0, F.slice("x", 1, 1)).otherwise(F.filter("x", lambda y: F.array_contains(F.col("taken"), y["at"])))
    one = F.get("x", F.lit(0))["s"]
    cut = F.concat(F.regexp_replace(F.substring(one, 1, max(0, most - 3)), f"[{ENDS}]+[^{ENDS}]*$", ""), F.lit("..."))
    return x.select(key, F.when((F.size("x") == 1) & (F.octet_length(one) > most), cut).otherwise(in_order(picked)).alias("summary"))
