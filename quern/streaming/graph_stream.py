"""Structured Streaming: windows over timed edges, upserts and batched imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import temporal


def timed_edges(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of events as timed edges; files of the folder's Parquet schema arrive over time."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("weight"))


def windowed(edges: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Edges and weight for each target and window. Windows are half-open here, unlike evolution()."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    grouped = edges.withWatermark("at", late).groupBy(w, "target").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"))
    return grouped.select(F.col("window.start").alias("window_start"), "target", "n_edges", "total_weight")


def sessions(edges: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each source."""
    return edges.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "source").agg(F.count("*").alias("n_edges")).select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_edges")


def distinct_edges(edges: DataFrame, late: str = "2 days") -> DataFrame:
    """Each (source, target, at) once, remembered for as long as late rows are taken."""
    return edges.withWatermark("at", late).dropDuplicatesWithinWatermark(["source", "target", "at"])


class EntityStore:
    """Entities under a folder, a version for each batch; a stream merges into it by foreachBatch.

    A batch writes a new version, then points to it, so a batch that is run again gives the same version.
    """

    def __init__(self, spark: SparkSession, path: str, how: str = "merge"):
        self.spark, self.path, self.how = spark, path, how
        self.version = max(self.versions(), default=-1)  # a stream that starts again goes on from it

    def versions(self) -> list[int]:
        """The whole versions in the folder."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], "id string, name string, entity_type string, confidence double")
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merges rows (id, name, entity_type, confidence, deleted); of several for an id the most confident counts."""
        new = batch.groupBy("id").agg(F.max(F.struct("confidence", "name", "entity_type", "deleted")).alias("r")).select("id", "r.name", "r.entity_type", "r.confidence", "r.deleted")
        gone = new.where("deleted").select("id")
        if batch_id <= self.version:  # run again: from the version before it
            self.version = max((v for v in self.versions() if v < batch_id), default=-1)
        merged = temporal.resolve_conflicts(self.read(), new.where("not deleted").drop("deleted"), self.how).join(gone, "id", "left_anti")
        merged.write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        self.version = batch_id

    def rollback(self, version: int) -> None:
        """Goes back to a version; later ones are removed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for v in self.versions():
            if v > version:
                path = hadoop.Path(f"{self.path}/v{v}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.version = version

    def start(self, updates: DataFrame, checkpoint: str, trigger: Callable | None = None):
        writer = updates.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.start()
