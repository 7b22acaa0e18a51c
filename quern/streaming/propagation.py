"""Lazy propagation of changes: queued by key, let go in batches by number or by age; and a log of what was done.

A queue lets its changes go once `most` of them wait or the oldest has waited `delay` seconds of event time, oldest first.
Queues are keyed, so they are spread over the cluster; a key's state is bounded by `most` changes.

Laws: a change that comes again within the watermark counts once; one that comes later than the watermark is dropped; changes without
an id, key or time are no changes; equal times stand by id. A batch that is applied again replaces what it did before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.runtime import stage

CHANGES = "key string, change_id string, kind string, target string, at timestamp"
RELEASED = "key string, reason string, place int, change_id string, kind string, target string, at timestamp"


def released(changes: DataFrame, most: int = 100, delay: int = 300, late: str = "10 minutes") -> DataFrame:
    """(key, reason, place, change...): a stream of the changes that are let go; reason: full or old."""

    def rows(key: str, reason: str, some: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key, reason, i, c, k, t, pd.Timestamp(at, unit="us")) for i, (at, c, k, t) in enumerate(some)], columns=["key", "reason", "place", "change_id", "kind", "target", "at"])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get)) if state.exists else []
        for part in parts:
            waiting += list(zip(part["at"].astype("datetime64[us]").astype("int64").tolist(), part["change_id"], part["kind"], part["target"]))
        waiting.sort(key=lambda x: (x[0], x[1]))
        while len(waiting) >= most:
            yield rows(key[0], "full", waiting[:most])
            waiting = waiting[most:]
        due = waiting[0][0] // 1000 + delay * 1000 if waiting else 0
        if waiting and (state.hasTimedOut or due <= state.getCurrentWatermarkMs()):
            yield rows(key[0], "old", waiting)
            waiting = []
        if waiting:
            state.update(tuple(list(c) for c in zip(*waiting)))
            state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()

    own = changes.where("change_id is not null and key is not null and at is not null").select("key", "change_id", "kind", "target", "at")
    once = own.withWatermark("at", late).dropDuplicatesWithinWatermark(["key", "change_id"])
    return once.groupBy("key").applyInPandasWithState(step, RELEASED, "at array<long>, change_id array<string>, kind array<string>, target array<string>", "append", GroupStateTimeout.EventTimeTimeout)


class ChangeLog:
    """What was propagated, and what failed, a folder for each batch; a batch that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: DataFrame, batch_id: int, status: str, tries: int) -> None:
        done = batch.select("key", "reason", "place", "change_id", "kind", "target", "at", F.lit(status).alias("status"), F.lit(tries).alias("tries"))
        done.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, since=None, status: str | None = None) -> DataFrame:
        """Entries with their batch, those at or after `since` and of a status where asked for."""
        schema = f"{RELEASED}, status string, tries int, batch long"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        found = found if since is None else found.where(F.col("at") >= F.lit(since))
        return found if status is None else found.where(F.col("status") == status)

    def rollback(self, batch_id: int) -> DataFrame:
        """Takes back the batches after one; returns what they had done, staged, for the caller to undo."""
        gone = self.read().where(F.col("batch") > batch_id)
        undone = stage(gone, "undone")
        for (b,) in gone.select("batch").distinct().collect():
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return undone


class Propagator:
    """Applies released changes batch by batch: a batch that fails is tried `retries` times more, then logged as failed."""

    def __init__(self, log: ChangeLog, apply: Callable[[DataFrame, int], None], retries: int = 3):
        self.log, self.apply, self.retries = log, apply, retries

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        for tries in range(1, self.retries + 2):
            try:
                self.apply(batch, batch_id)
            except Exception:  # the user's function; what it raises is told by the log
                continue
            return self.log.append(batch, batch_id, "propagated", tries)
        self.log.append(batch, batch_id, "failed", self.retries + 1)

    def start(self, changes: DataFrame, checkpoint: str, **rules):
        return released(changes, **rules).writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
