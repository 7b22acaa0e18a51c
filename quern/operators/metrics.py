"""Measures of answers, checks of tables and steering of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx


def paired(docs: DataFrame, references: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(doc_id, text, reference): each document with a reference, by its id modulo the references' number.

    References are numbered in order of id and text, a stated set that is broadcast, at most `most` rows.
    """
    n = references.count()
    if n > most:
        raise ValueError(f"{n} references; at most {most}")
    r = references.select(F.col("text").alias("reference"), (F.row_number().over(Window.orderBy("item_id", "text")) - 1).alias("place"))
    return docs.select("doc_id", "text", F.pmod("doc_id", F.lit(max(1, n))).alias("place")).join(F.broadcast(r), "place").drop("place")


def exact_and_f1(pairs: DataFrame) -> DataFrame:
    """(doc_id, em, f1): equal but for case, and words of the text that the reference has, not clipped."""
    p = pairs.select("doc_id", (F.lower(F.trim("text")) == F.lower(F.trim("reference"))).alias("em"), tx.words(F.lower("text")).alias("a"), tx.words(F.lower("reference")).alias("b"))
    p = p.withColumn("hit", F.size(F.filter("a", lambda w: F.array_contains("b", w))))
    x, y = F.col("hit") / F.size("a"), F.col("hit") / F.size("b")
    return p.select("doc_id", "em", F.round(F.when(F.col("hit") == 0, 0.0).otherwise(2 * x * y / (x + y)), 6).alias("f1"))


def recall(pairs: DataFrame) -> DataFrame:
    a, b = F.array_distinct(tx.words(F.lower("text"))), F.array_distinct(tx.words(F.lower("reference")))
    return pairs.select("doc_id", F.round(F.size(F.array_intersect(a, b)) / F.size(b), 6).alias("recall"))


def histogram(df: DataFrame, key: str, value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """(key, n, total, mean, least, most, p50, p95, p99): a quantile is the value at index floor(n p) of the sorted rows.

    Equal values are counted first; then only distinct values are ranked, so what is sorted is no larger than
    the number of values, not of rows.
    """
    quantiles = quantiles or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    all_ = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy(value))).join(F.broadcast(all_.select(key, "n")), key)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.round(value, 6)))
    return all_.join(upto.groupBy(key).agg(*[at(p).alias(name) for name, p in quantiles.items()]), key)


def checks(df: DataFrame, what: str, failing: dict[str, Column], unique: str | None = None) -> DataFrame:
    """(what, check, rows, failed): one pass for all conditions, and one for the uniqueness of a column."""
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"f{i}") for i, c in enumerate(failing.values())]
    one = df.agg(F.count("*").alias("rows"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(f"f{i}", F.lit(0)).alias("failed")) for i, n in enumerate(failing)]))
    out = one.select("rows", rows.alias("x")).select(F.lit(what).alias("what"), "x.check", "rows", "x.failed")
    if unique is None:
        return out
    ids = df.agg(F.count("*").alias("rows"), F.countDistinct(unique).alias("ids"))
    return out.union(ids.select(F.lit(what), F.lit("unique id"), "rows", (F.col("rows") - F.col("ids"))))


def reweight(steps: DataFrame, key: str, order: str, value: str, window: int = 4, least: float = 0.01, boost: float = 0.05) -> DataFrame:
    """(key, slope, weight): objectives whose slope over the last steps is under `least` weigh more; weights sum to 1."""
    w = Window.partitionBy(key)
    s = steps.select(key, F.col(value).alias("v"), F.lag(value, window - 1).over(w.orderBy(order)).alias("before"), F.row_number().over(w.orderBy(F.desc(order))).alias("rn")).where("rn = 1 and before is not null")
    s = s.select(key, ((F.col("v") - F.col("before")) / (window - 1)).alias("slope")).withColumn("w", F.when(F.col("slope") < least, 1 + boost).otherwise(1.0))
    return s.join(F.broadcast(s.agg(F.sum("w").alias("all")))).select(key, F.round("slope", 6).alias("slope"), F.round(F.col("w") / F.col("all"), 9).alias("weight"))
