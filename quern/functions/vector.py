"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / n))


def hash_embedding(word: Column, dims: int = 128) -> Column:
    """A vector of values in [-1, 1) made from digests of the word, the same on every engine."""
    value = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("#", word, i.cast("string"))), 1, 8), 16, 10).cast("long") % 2000) / 1000.0 - 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value)


def text_embeddings(df: DataFrame, key: str, text: str, dims: int = 128) -> DataFrame:
    """(key, dim, value): the mean of the unit vectors of a text's words, made unit. Each distinct word's vector is made once;
    a text without words has no rows."""
    words = df.select(key, F.explode(tx.words(F.lower(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    vectors = words.select("word").distinct().select("word", F.posexplode(hash_embedding(F.col("word"), dims)).alias("dim", "x"))
    unit = vectors.withColumn("u", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("word"))))
    mean = words.join(unit, "word").groupBy(key, "dim").agg((F.sum(F.col("times") * F.col("u")) / F.sum("times")).alias("m"))
    return mean.select(key, F.col("dim").cast("long").alias("dim"), (F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))).alias("value"))
