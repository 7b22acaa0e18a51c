"""Operators on timed edges (source, target, edge_type, at, weight[, start_at, end_at]) and on snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_at(edges: DataFrame, at: int) -> DataFrame:
    """Edges active at a time: their interval holds it (closed), or without one their time is it."""
    return edges.where(F.when(F.col("start_at").isNotNull() & F.col("end_at").isNotNull(), F.lit(at).between(F.col("start_at"), F.col("end_at"))).otherwise(F.col("at") == at))


def snapshot_range(edges: DataFrame, start: int, end: int) -> DataFrame:
    return edges.where(F.col("at").between(start, end))


def node_lifetime(edges: DataFrame) -> DataFrame:
    """(node, first_at, last_at, edges)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "at")
    return ends.groupBy("node").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("edges"))


def evolution(edges: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Edges, nodes and weight of the windows [t, t + step], closed at both ends; a boundary edge is in both.

    An edge names its windows itself (two at most), so nothing is joined by range.
    """
    k = F.floor((F.col("at") - start) / step).cast("long")
    both = F.when(((F.col("at") - start) % step == 0) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    inside = edges.where(F.col("at") >= start).select("*", F.explode(both).alias("k")).where(F.col("k") * step + start <= end)
    totals = inside.groupBy("k").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("total_weight"))
    nodes = inside.select("k", F.explode(F.array("source", "target")).alias("node")).distinct().groupBy("k").agg(F.count("*").alias("n_nodes"))
    return totals.join(nodes, "k").select((F.col("k") * step + start).alias("window_start"), "n_edges", "n_nodes", "total_weight")


def churn(before: DataFrame, after: DataFrame, key: str = "node") -> DataFrame:
    """(node, change): added, removed or stable."""
    b, a = before.select(key).distinct().withColumn("b", F.lit(1)), after.select(key).distinct().withColumn("a", F.lit(1))
    return b.join(a, key, "full").select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("stable").alias("change"))


def content_hash(row_id, *properties):
    """sha256 of the id and the properties in a fixed order."""
    return F.sha2(F.concat_ws("|", row_id.cast("string"), *[F.coalesce(p.cast("string"), F.lit("")) for p in properties]), 256)


def delta(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or modified rows by content hash, one full outer join."""
    b = before.select(key, content_hash(F.col(key), *[F.col(c) for c in columns]).alias("hb"))
    a = after.select(key, content_hash(F.col(key), *[F.col(c) for c in columns]).alias("ha"))
    change = F.when(F.col("hb").isNull(), "added").when(F.col("ha").isNull(), "removed").when(F.col("ha") != F.col("hb"), "modified")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def resolve_conflicts(existing: DataFrame, new: DataFrame, how: str = "merge") -> DataFrame:
    """Upserts entities (id, name, entity_type, confidence): keep_existing, keep_new or merge (higher confidence wins)."""
    e = existing.select("id", *[F.col(c).alias(f"e_{c}") for c in ("name", "entity_type", "confidence")])
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("name", "entity_type", "confidence")])
    take_new = {"keep_existing": F.col("e_confidence").isNull(), "keep_new": F.col("n_confidence").isNotNull(), "merge": F.col("e_confidence").isNull() | (F.col("n_confidence") > F.col("e_confidence"))}[how]
    return e.join(n, "id", "full").select("id", *[F.when(take_new, F.col(f"n_{c}")).otherwise(F.col(f"e_{c}")).alias(c) for c in ("name", "entity_type", "confidence")])


def overlapping(edges: DataFrame, step: int = 86400) -> DataFrame:
    """Pairs of overlapping edges of one source: the earlier's columns and b_at, b_type.

    An interval is filed under each step that it touches; a pair counts in the first step that both touch, so it
    comes once and no source is joined with itself whole.
    """
    first = F.floor(F.col("start_at") / step)
    filed = edges.withColumn("first", first).withColumn("day", F.explode(F.sequence(first, F.floor(F.col("end_at") / step))))
    other = filed.select("source", "day", F.col("start_at").alias("b_start"), F.col("end_at").alias("b_end"), F.col("at").alias("b_at"), F.col("edge_type").alias("b_type"), F.col("first").alias("b_first"))
    both = filed.join(other, ["source", "day"]).where("day = greatest(first, b_first) and start_at <= b_end and b_start <= end_at and (at < b_at or (at = b_at and edge_type < b_type))")
    return both.drop("day", "first", "b_first", "b_start", "b_end")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds to each left row the last `value` (a time) of its key at or before `at`; one sort of both, no join by range."""
    rest = [c for c in left.columns if c not in (key, at)]
    rows = left.select(key, F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(*rest).alias("own")) if rest else None
    marks = right.select(key, F.col(value).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"))
    w = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("side") == 0, F.col("t"))).over(w)
    return rows.unionByName(marks).withColumn("last", last).where("side = 1").select(*[F.col(f"own.{c}") for c in rest], key, F.col("t").alias(at), F.col("last").alias(value))
