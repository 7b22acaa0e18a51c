"""The registered queries of this subpackage: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, chat, collocations, decontaminate, fingerprint, kdtree, licence, near_duplicates, ordinal, packing, toxicity, warc, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.grades_of(table(spark, sf_dir, "labels")))
    return ordinal.classify(docs, model, keep=["doc_id"])


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns, chat.neighbours(turns))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kdtree.shard(table(spark, sf_dir, "documents"), shards=40)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_and_read(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN, digests=True).drop("text")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_quality, op3_preferences, op4_fingerprints, op5_kdtree, op6_packing, op7_near_duplicates, op8_decontamination, op9_bpe, op10_licences, op11_collocations, op12_toxicity, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from quern.llm.sql import ORACLES

    return dict(ORACLES)
