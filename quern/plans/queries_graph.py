"""Graph, temporal and delta queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph, temporal
from quern.plans.registry import query
from quern.sources import fixtures as fx

E, R, P, T = fx.ENTITIES, fx.RELATIONSHIPS, fx.PLACES, fx.TIMED
G = f"with {E}, {R}, {P}"
PAIRS = "pairs as (select distinct source, target from (select source, target from places union all select target, source from places) x where source <> target)"


@query(f"with {E} select id, name, entity_type, confidence from entities where entity_type = 'NATION'")
def op_entity_scan(t):
    return fx.entities(t).where("entity_type = 'NATION'")


@query(f"with {E} select id, name from entities where confidence >= 0.9 and entity_type = 'SUPPLIER'")
def op_filter(t):
    return fx.entities(t).where("confidence >= 0.9 and entity_type = 'SUPPLIER'").select("id", "name")


@query(f"{G} select e.id, count(r.target) as n_out from entities e left join relationships r on r.source = e.id and r.relation_type = 'SUPPLIES' where e.entity_type in ('SUPPLIER', 'REGION') group by e.id")
def op_join_left(t):
    e = fx.entities(t).where("entity_type in ('SUPPLIER', 'REGION')")
    r = fx.relationships(t).where("relation_type = 'SUPPLIES'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return e.join(r, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_out"))


@query(f"with {E} select id, entity_type from entities where entity_type = 'REGION' union select id, entity_type from entities where confidence >= 0.98")
def op_union(t):
    e = fx.entities(t)
    return e.where("entity_type = 'REGION'").union(e.where("confidence >= 0.98")).select("id", "entity_type").distinct()


@query(f"with {E} select id, confidence from entities order by confidence desc, id limit 25")
def op_limit(t):
    return fx.entities(t).select("id", "confidence").orderBy(F.desc("confidence"), "id").limit(25)


@query(f"{G} select target as id, relation_type, confidence from relationships where source = 'NATION_3'")
def neighbors_out(t):
    return graph.neighbours_out(fx.relationships(t), "NATION_3").select(F.col("target").alias("id"), "relation_type", "confidence")


@query(f"with {E} select id, name from entities where contains(lower(name), 'an')")
def find_entities_by_name(t):
    return fx.entities(t).where("contains(lower(name), 'an')").select("id", "name")


@query(f"""with {E}, {R} select 'entities' as what, entity_type as kind, count(*) as n from entities group by entity_type
 union all select 'relationships', relation_type, count(*) from relationships group by relation_type""")
def graph_statistics(t):
    e = fx.entities(t).groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "kind", "n")
    return e.union(fx.relationships(t).groupBy(F.col("relation_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("relationships").alias("what"), "kind", "n"))


DEGREES = "degrees as (select node, count(*) as degree from (select source as node from relationships union all select target from relationships) x group by node)"


@query(f"with {E}, {R}, {DEGREES} select e.id as node, round(coalesce(d.degree, 0) / cast((select count(*) - 1 from entities) as double), 6) as centrality from entities e left join degrees d on d.node = e.id")
def degree_centrality(t):
    return graph.degree_centrality(fx.entities(t), fx.relationships(t))


@query(f"with {R}, {DEGREES} select node, degree from degrees order by degree desc, node limit 20")
def top_degree_nodes(t):
    return graph.degrees(fx.relationships(t)).orderBy(F.desc("degree"), "node").limit(20)


@query(f"with {E}, {R} select n, e, round(2.0 * e / (cast(n as double) * (n - 1)), 9) as density from (select count(*) as n from entities) a, (select count(*) as e from relationships) b")
def density(t):
    return graph.density(fx.entities(t), fx.relationships(t))


SMALL = """small as (select distinct 'SUPPLIER_' || cast(l_suppkey as varchar) as source, 'PART_' || cast(l_partkey as varchar) as target from lineitem
 union select distinct 'SUPPLIER_' || cast(s_suppkey as varchar), 'NATION_' || cast(s_nationkey as varchar) from supplier
 union select distinct 'PART_' || cast(p_partkey as varchar), 'NATION_' || cast(p_partkey % 25 as varchar) from part)"""


def supplied(t):
    """Suppliers, the parts they supply, and nations of both: a graph with triangles."""
    e = t.lineitem.select(F.concat(F.lit("SUPPLIER_"), "l_suppkey").alias("source"), F.concat(F.lit("PART_"), "l_partkey").alias("target")).distinct()
    s = t.supplier.select(F.concat(F.lit("SUPPLIER_"), "s_suppkey").alias("source"), F.concat(F.lit("NATION_"), "s_nationkey").alias("target"))
    p = t.part.select(F.concat(F.lit("PART_"), "p_partkey").alias("source"), F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("target"))
    return e.union(s).union(p)


@query(f"""with {SMALL}, pairs as (select distinct source, target from (select source, target from small union all select target, source from small) x where source <> target),
 k as (select source as node, count(*) as neighbours from pairs group by source having count(*) >= 2),
 tri as (select a.source as node, count(*) as n from pairs a join pairs b on a.source = b.source and a.target < b.target join pairs c on c.source = a.target and c.target = b.target group by a.source)
 select k.node, k.neighbours, round(2.0 * coalesce(tri.n, 0) / (cast(k.neighbours as double) * (k.neighbours - 1)), 6) as coefficient from k left join tri on tri.node = k.node""")
def clustering_coefficient(t):
    return graph.clustering(supplied(t))


@query(f"""with {E}, {R} select 'orphan' as problem, count(*) as n from entities e where not exists (select 1 from relationships r where r.source = e.id)
 union all select 'broken', count(*) from relationships r where not exists (select 1 from entities e where e.id = r.target)""")
def consistency_report(t):
    e, r = fx.entities(t), fx.relationships(t)
    orphans = e.join(r.select(F.col("source").alias("id")).distinct(), "id", "left_anti").agg(F.lit("orphan").alias("problem"), F.count("*").alias("n"))
    return orphans.union(r.join(e.select(F.col("id").alias("target")), "target", "left_anti").agg(F.lit("broken").alias("problem"), F.count("*").alias("n")))


# temporal ---------------------------------------------------------------------------------------------
START, STEP = 1704067200, 86400  # 2024-01-01, a day


def intervals(t):
    return fx.timed(t).withColumn("start_at", F.col("at")).withColumn("end_at", F.col("at") + (F.col("at") % 24) * 3600)


@query(f"with {T} select source, target, at from timed where {START} + 900000 between at and at + (at % 24) * 3600")
def snapshot_at(t):
    return temporal.snapshot_at(intervals(t), START + 900000).select("source", "target", "at")


@query(f"with {T} select source, target, at, weight from timed where at between {START} and {START} + 172800")
def snapshot_range(t):
    return temporal.snapshot_range(fx.timed(t), START, START + 172800).select("source", "target", "at", "weight")


@query(f"with {T} select node, min(at) as first_at, max(at) as last_at, count(*) as edges from (select source as node, at from timed union all select target, at from timed) x group by node")
def node_lifetime(t):
    return temporal.node_lifetime(fx.timed(t))


@query(f"with {T} select min(at) as first_at, max(at) as last_at, count(distinct at) as timestamps from timed")
def time_range(t):
    return fx.timed(t).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.countDistinct("at").alias("timestamps"))


@query(f"""with {T}, w as (select unnest(range({START}, {START} + 30 * {STEP} + 1, {STEP})) as ws), j as (select ws, t.* from w join timed t on t.at between ws and ws + {STEP}),
 n as (select ws, count(distinct node) as n_nodes from (select ws, source as node from j union all select ws, target from j) x group by ws)
 select cast(j.ws as bigint) as window_start, count(*) as n_edges, any_value(n.n_nodes) as n_nodes, round(sum(weight), 4) as total_weight from j join n on n.ws = j.ws group by j.ws""")
def evolution_metrics(t):
    return temporal.evolution(fx.timed(t), START, START + 30 * STEP, STEP)


@query(f"""with {T}, d as (select source as node, count(*) filter (at < {START} + 1296000) as early, count(*) filter (at >= {START} + 1296000) as late from timed group by 1)
 select node, round(case when early = 0 then late else (late - early) / cast(early as double) end, 6) as growth from d order by 2 desc, 1 limit 20""")
def top_growing_nodes(t):
    half = START + 1296000
    d = fx.timed(t).groupBy(F.col("source").alias("node")).agg(F.sum((F.col("at") < half).cast("long")).alias("early"), F.sum((F.col("at") >= half).cast("long")).alias("late"))
    return d.select("node", F.round(F.when(F.col("early") == 0, F.col("late").cast("double")).otherwise((F.col("late") - F.col("early")) / F.col("early")), 6).alias("growth")).orderBy(F.desc("growth"), "node").limit(20)


# deltas -----------------------------------------------------------------------------------------------
AFTER = """after as (select o_orderkey + case when o_orderkey % 5 = 0 then 10000000 else 0 end as o_orderkey, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_custkey from orders where o_orderkey % 7 <> 0)"""


def orders_after(t):
    o = t.orders.where("o_orderkey % 7 <> 0")
    return o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 5 == 0, 10000000).otherwise(0)).alias("o_orderkey"), F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")


@query(f"""with {AFTER} select * from (select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' when a.o_orderstatus <> b.o_orderstatus or a.o_custkey <> b.o_custkey then 'modified' end as change
 from orders b full join after a on a.o_orderkey = b.o_orderkey) x where change is not null""")
def snapshot_delta_nodes(t):
    return temporal.delta(t.orders, orders_after(t), "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("select o_orderkey, sha256(cast(o_orderkey as varchar) || '|' || o_orderstatus || '|' || cast(o_custkey as varchar)) as content_hash from orders")
def content_hash(t):
    return t.orders.select("o_orderkey", temporal.content_hash(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")).alias("content_hash"))


@query(f"""with {E}, new as (select id, name || ' II' as name, entity_type, confidence + case when id like '%3' then 0.2 else -0.2 end as confidence from entities where entity_type in ('NATION', 'SUPPLIER') union all select 'NATION_x', 'Nowhere', 'NATION', cast(0.1 as double))
 select coalesce(e.id, n.id) as id, case when e.id is null or n.confidence > e.confidence then n.name else e.name end as name, round(case when e.id is null or n.confidence > e.confidence then n.confidence else e.confidence end, 6) as confidence
 from entities e full join new n on n.id = e.id""")
def conflict_resolve(t):
    e = fx.entities(t)
    shift = F.when(F.col("id").like("%3"), 0.2).otherwise(-0.2)
    new = e.where("entity_type in ('NATION', 'SUPPLIER')").select("id", F.concat("name", F.lit(" II")).alias("name"), "entity_type", (F.col("confidence") + shift).alias("confidence"))
    new = new.union(t.spark.sql("select 'NATION_x' as id, 'Nowhere' as name, 'NATION' as entity_type, 0.1D as confidence"))
    return temporal.resolve_conflicts(e, new).select("id", "name", F.round("confidence", 6).alias("confidence"))

