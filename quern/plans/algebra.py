"""A small algebra of graph queries: build, estimate, explain, run. Catalyst optimises what it runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import graph


@dataclass
class Op:
    """A node of a query: kind, its arguments and its inputs."""

    kind: str
    args: dict = field(default_factory=dict)
    inputs: tuple[Op, ...] = ()

    def filter(self, column: str, value) -> Op:
        return Op("Filter", {"column": column, "value": value}, (self,))

    def join(self, other: Op, how: str = "inner") -> Op:
        return Op("Join", {"how": how}, (self, other))

    def neighbours(self, relation: str | None = None, hops: int = 1) -> Op:
        return Op("Neighbors", {"relation": relation, "hops": hops}, (self,))

    def union(self, other: Op) -> Op:
        return Op("Union", {}, (self, other))

    def limit(self, n: int) -> Op:
        return Op("Limit", {"n": n}, (self,))


def scan(kind: str | None = None) -> Op:
    return Op("EntityScan", {"type": kind})


@dataclass
class Statistics:
    """Counts from which costs are estimated."""

    entities: int
    by_type: dict[str, int]
    edges: int

    @classmethod
    def of(cls, entities: DataFrame, relationships: DataFrame) -> Statistics:
        by = {r["entity_type"]: r["count"] for r in entities.groupBy("entity_type").count().collect()}
        return cls(sum(by.values()), by, relationships.count())


def estimate(op: Op, s: Statistics) -> tuple[float, float]:
    """(rows, cost)."""
    parts = [estimate(x, s) for x in op.inputs]
    below = sum(c for _, c in parts)
    if op.kind == "EntityScan":
        n = s.by_type.get(op.args["type"], 0) if op.args["type"] else s.entities
        return float(n), float(n)
    if op.kind == "Filter":
        return parts[0][0] * 0.1, below + parts[0][0]
    if op.kind == "Join":
        a, b = parts[0][0], parts[1][0]
        return (min(a, b) if op.args["how"] == "inner" else a), below + a + b
    if op.kind == "Neighbors":
        degree = s.edges / max(1, s.entities)
        rows = min(float(s.entities), parts[0][0] * max(1.0, degree) ** op.args["hops"])
        return rows, below + rows
    if op.kind == "Union":
        return 0.9 * (parts[0][0] + parts[1][0]), below + parts[0][0] + parts[1][0]
    return min(parts[0][0], float(op.args["n"])), below


def explain(op: Op, s: Statistics, depth: int = 0) -> str:
    rows, cost = estimate(op, s)
    said = ", ".join(f"{k}={v}" for k, v in op.args.items() if v is not None)
    return "\n".join([f"{'  ' * depth}{op.kind}({said}) rows={rows:.0f} cost={cost:.0f}", *[explain(x, s, depth + 1) for x in op.inputs]])


def run(op: Op, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities (id, name, entity_type, confidence) that a query gives; limits are by id."""
    parts = [run(x, entities, relationships) for x in op.inputs]
    if op.kind == "EntityScan":
        return entities.where(F.col("entity_type") == op.args["type"]) if op.args["type"] else entities
    if op.kind == "Filter":
        return parts[0].where(F.col(op.args["column"]) == op.args["value"])
    if op.kind == "Join":
        how = {"inner": "left_semi", "anti": "left_anti"}[op.args["how"]]
        return parts[0].join(parts[1].select("id"), "id", how)
    if op.kind == "Neighbors":
        edges = relationships if op.args["relation"] is None else relationships.where(F.col("relation_type") == op.args["relation"])
        near = graph.bfs(edges, parts[0], op.args["hops"]).where("distance > 0").select(F.col("node").alias("id"))
        return entities.join(near, "id", "left_semi")
    if op.kind == "Union":
        return parts[0].unionByName(parts[1]).distinct()
    return parts[0].orderBy("id").limit(op.args["n"])
