"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import attach_groups, stage


def _least_neighbours(pairs: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): each pair with the least v of its u; a hub's rows are spread (see attach_groups)."""
    groups = stage(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
    return attach_groups(pairs, groups, "u", "n", ["v"], rows)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Each round halves what is left at least on long paths and ends at once on stars. Its pairs are staged in
    the shared folder, so lineage stays short. Nulls and loops are no edges.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = stage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    rows = now.count()
    for _ in range(most_rounds):
        if not rows:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbours(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stage(large, "large-star")
        n = large.count()
        told = _least_neighbours(large, n)
        small = told.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stage(small, "small-star")
        new_rows = new.count()
        same = new_rows == rows and new.join(now, ["u", "v"], "left_anti").isEmpty()
        now, rows = new, new_rows
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
