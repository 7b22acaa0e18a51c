"""Registered queries: a name, a callable on (spark, sf_dir) and, where SQL expresses it, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (t) -> DataFrame, t giving tables by name."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = for_duckdb(sql)
        return function

    return add


def for_duckdb(sql: str) -> str:
    """Quotes the column `at`, a keyword there, and writes lambdas in its way."""
    sql = re.sub(r"(?<![\w'\"])at(?![\w'\"])", '"at"', sql)
    return re.sub(r"\bx -> ", "lambda x: ", sql)


class Tables:
    """The Parquet tables of a folder, read when they are first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
