"""The corpus pipeline: quality, near duplicates, decontamination, tokens. Part of subpackage llm.

Stages decide by row, never by id. Defined cases: rows with a null id are documents like others; rows with
equal ids and other texts are documents of their own; repeated rows are copies, of which one is kept; null and
empty texts, which the classifier rejects, are otherwise documents without words; an empty table gives an empty
table; columns other than those of documents are dropped.

A stage's result is to be written before the next stage is called, as run() does: a stage begins by removing the
tables that the one before staged.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, near_duplicates, ordinal
from quern.llm.queries import PATTERN, RANKS
from quern.runtime import drop, stage, staged, sweep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_LEFT: dict[str, list[str]] = {}


def alone(function):
    """Has a stage remove what the one before staged, and remembers what it stages itself."""

    @wraps(function)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop(spark, _LEFT.pop(app, []))
        sweep(spark)
        before = set(staged(spark))
        out = function(spark, docs, sf_dir)
        _LEFT[app] = [p for p in staged(spark) if p not in before]
        return out

    return run_alone


@alone
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on this corpus' ratings, doesn't reject."""
    model = ordinal.train(docs, ordinal.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal.classify(docs.select(COLUMNS), model).where("kept").select(COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of their own for each row.

    Rows of files always have the same places, and so numbers; documents that a shuffle deals out are staged first.
    """
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stage(docs.select(COLUMNS), "rows")
    return docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS)


@alone
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, keeps one row: the one of least id, null ids last, then any of those."""
    rows = numbered(docs)
    groups = near_duplicates.components(rows.select("row", "text"), key="row").select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", "doc_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))["row"]
    kept = stage(groups.join(ids, "row").groupBy("component_id").agg(least.alias("row")).select("row"), "kept")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


@alone
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of a benchmark item."""
    rows = numbered(docs)
    bad = decontaminate.report(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row").where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(bad, "row", "left_anti").select(COLUMNS)


@alone
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens by number and digest, and the digest of what they decode to."""
    return bpe.encode(docs.select("doc_id", "text"), RANKS, PATTERN, digests=True).drop("text")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicate), ("benchmark decontamination", decontaminated), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
