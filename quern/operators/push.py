"""PageRank that follows changes: stored values and residuals, pushed from the changed nodes only.

A node's value is y = (1 - d) s + d sum of (share of an edge) y over its incoming edges, with nothing for nodes without
outgoing edges; ranks are the values over their sum, which equals PageRank whose dangling mass goes to the seeds. What a
change of edges or seeds leaves open is a residual at a few nodes; it is pushed along their edges until no residual is
above a bound. Edges and values are stored in buckets by a hash of their node, so that a push reads the buckets
of its frontier and a change rewrites those it touched.

Laws: several edges between two nodes add their weights; null ends and weights that aren't above 0 are no edges; a node of
an edge that `nodes` doesn't name has seed 0; a change that removes more than there is removes the edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import hot_keys, new_path, replicate_join, stage

#: Buckets of the stored tables; damping; the residual, in seeds, that is left lying.
BUCKETS, DAMPING, LEFT = 64, 0.85, 1e-10


def bucket(node: str, n: int):
    return F.pmod(F.xxhash64(node), F.lit(n)).cast("int").alias("bucket")


@dataclass
class Ranks:
    """Stored state: `edges` (source, target, w, share) by bucket of the source, `values` (node, y, r) by bucket of the node."""

    spark: object
    edges_path: str
    values_path: str
    buckets: int
    damping: float

    def edges(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(self.edges_path, "source string, target string, w double, share double", buckets)

    def values(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read(self.values_path, "node string, y double, r double", buckets)

    def _read(self, path: str, columns: str, buckets: list[int] | None) -> DataFrame:
        df = self.spark.read.schema(f"{columns}, bucket int").parquet(path)
        return df.drop("bucket") if buckets is None else df.where(F.col("bucket").isin(buckets)).drop("bucket")

    def of(self, nodes: DataFrame) -> list[int]:
        """The buckets of some nodes: at most as many as there are."""
        return [r[0] for r in nodes.select(bucket("node", self.buckets)).distinct().collect()]

    def ranks(self) -> DataFrame:
        """(node, rank), summing to 1."""
        total = self.values().agg(F.sum("y")).collect()[0][0] or 1.0
        return self.values().select("node", (F.col("y") / F.lit(total)).alias("rank"))


def shares(weights: DataFrame) -> DataFrame:
    """Adds share to (source, target, w): a hub's edges are dealt out."""
    sums = weights.groupBy("source").agg(F.sum("w").alias("all_w"))
    return replicate_join(weights, sums, "source", "target", hot_keys(weights, ["source"])).select("source", "target", "w", (F.col("w") / F.col("all_w")).alias("share"))


def weighted(edges: DataFrame, weight: str) -> DataFrame:
    own = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col(weight) > 0))
    return own.select(F.col("source").cast("string"), F.col("target").cast("string"), F.col(weight).cast("double").alias("w"))


def write(df: DataFrame, node: str, path: str, n: int) -> None:
    """Writes the buckets that df has rows of, in place of those there are."""
    df.withColumn("bucket", bucket(node, n)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def start(nodes: DataFrame, edges: DataFrame, weight: str = "confidence", seeds: DataFrame | None = None, damping: float = DAMPING, left: float = LEFT, buckets: int = BUCKETS) -> tuple[Ranks, DataFrame]:
    """State for a graph from scratch, every node its own frontier, and the report of push(). seeds: id, p (default: 1 for each node)."""
    spark = nodes.sparkSession
    state = Ranks(spark, new_path(spark, "rank-edges"), new_path(spark, "rank-values"), buckets, damping)
    held = stage(shares(weighted(edges, weight).groupBy("source", "target").agg(F.sum("w").alias("w"))), "shares")
    write(held, "source", state.edges_path, buckets)
    seeds = nodes.select(F.col("id").cast("string").alias("node"), F.lit(1.0).alias("p")) if seeds is None else seeds.select(F.col("id").cast("string").alias("node"), F.col("p").cast("double"))
    own = held.select("source").union(held.select("target")).select(F.col("source").alias("node"), F.lit(0.0).alias("p")).distinct()
    values = seeds.where("node is not null").union(own).groupBy("node").agg(F.sum("p").alias("p"))
    write(values.select("node", F.lit(0.0).alias("y"), ((1 - damping) * F.col("p")).alias("r")), "node", state.values_path, buckets)
    return state, push(state, state.values(), left)


def push(state: Ranks, frontier: DataFrame, left: float = LEFT) -> DataFrame:
    """Pushes residuals from some nodes (node, y, r) until none is above `left`; the report (round, frontier, edges, touched).

    A round reads the edges of its frontier's buckets and keeps what it has touched in a table of its own; the stored
    values are read where a residual arrives first, and written once, at the end.
    """
    own = stage(frontier.select("node", "y", "r"), "pushed")
    report, high = [], F.abs("r") > left
    while True:
        told = own.groupBy(bucket("node", state.buckets)).agg(F.count("*"), F.sum(high.cast("long"))).collect()  # a row for each bucket
        n = sum(r[2] for r in told)
        if report:
            report[-1] += (sum(r[1] for r in told),)
        if not n:
            break
        edges = state.edges([r[0] for r in told if r[2]]).join(own.where(high).select(F.col("node").alias("source"), F.col("r").alias("sent")), "source")
        sent = edges.groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("sent") * F.lit(state.damping)).alias("add"), F.count("*").alias("m"))
        sent = stage(sent.join(own.select("node", F.lit(True).alias("here")), "node", "left"), "sent")
        new = sent.groupBy(bucket("node", state.buckets)).agg(F.sum("m"), F.count(F.when(F.col("here").isNull(), 1))).collect()
        found = state.values([r[0] for r in new if r[2]]).join(sent.where("here is null").select("node"), "node", "left_semi")
        settled = own.select("node", F.when(high, F.col("y") + F.col("r")).otherwise(F.col("y")).alias("y"), F.when(high, 0.0).otherwise(F.col("r")).alias("r"))
        own = stage(settled.unionByName(found).join(sent.select("node", "add"), "node", "left").select("node", "y", (F.col("r") + F.coalesce("add", F.lit(0.0))).alias("r")), "pushed")
        report.append((len(report) + 1, n, sum(r[1] for r in new)))
    touched = state.of(own)
    rest = state.values(touched).join(own.select("node"), "node", "left_anti")
    write(stage(rest.unionByName(own), "values"), "node", state.values_path, state.buckets)
    return state.spark.createDataFrame(report, "round int, frontier long, edges long, touched long")


def change(state: Ranks, added: DataFrame | None = None, removed: DataFrame | None = None, nodes: DataFrame | None = None, weight: str = "confidence", left: float = LEFT) -> DataFrame:
    """Adds and removes weight of edges (source, target, weight) and adds nodes (id) with seed 1; the report of push().

    The residuals of a changed node's old and new targets move by the difference of its shares; no other node takes part.
    """
    empty = state.spark.createDataFrame([], "source string, target string, w double")
    plus = empty if added is None else weighted(added, weight)
    minus = empty if removed is None else weighted(removed, weight).withColumn("w", -F.col("w"))
    delta = stage(plus.unionByName(minus).groupBy("source", "target").agg(F.sum("w").alias("w")), "changes")
    sources = delta.select(F.col("source").alias("node")).distinct()
    at = state.of(sources)
    before = stage(state.edges(at), "before")
    mine = sources.withColumnRenamed("node", "source")
    old = before.join(mine, "source", "left_semi")
    new = stage(shares(old.select("source", "target", "w").unionByName(delta).groupBy("source", "target").agg(F.sum("w").alias("w")).where("w > 1e-12")), "after")
    kept = before.join(mine, "source", "left_anti")
    moved = new.select("source", "target", "share").unionByName(old.select("source", "target", (-F.col("share")).alias("share")))
    sent = moved.join(state.values(at).select(F.col("node").alias("source"), "y"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("y") * F.lit(state.damping)).alias("r"))
    fresh = delta.select(F.explode(F.array("source", "target")).alias("node")).withColumn("r", F.lit(0.0))
    if nodes is not None:
        fresh = fresh.unionByName(nodes.where("id is not null").select(F.col("id").cast("string").alias("node"), F.lit(1 - state.damping).alias("r")))
    open_ = stage(sent.unionByName(fresh).groupBy("node").agg(F.sum("r").alias("add")), "open")
    held = state.values(state.of(open_))
    frontier = stage(open_.join(held, "node", "left").select("node", F.coalesce("y", F.lit(0.0)).alias("y"), (F.coalesce("r", F.lit(0.0)) + F.col("add")).alias("r")), "frontier")
    write(stage(kept.unionByName(new), "edges"), "source", state.edges_path, state.buckets)
    if not kept.unionByName(new).isEmpty():
        gone = set(at) - {r[0] for r in kept.unionByName(new).select(bucket("source", state.buckets)).distinct().collect()}
    else:
        gone = set(at)
    for b in gone:  # a bucket that lost its last edge has no row to be written
        path = state.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state.edges_path}/bucket={b}")
        path.getFileSystem(state.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return push(state, frontier, left)
