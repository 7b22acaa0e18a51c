"""Communities, changing ranks, walks and graph features over the whole graph of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph_features, leiden as ld, push, walks
from quern.plans.registry import query
from quern.runtime import stage
from quern.sources import fixtures as fx

G = f"with recursive {fx.ENTITIES}, {fx.RELATIONSHIPS}"


@query()
def leiden(t):
    """Levels and labels; tests hold the modularity against DuckDB, exhaustive search and sequential moves."""
    return ld.leiden(fx.relationships(t), weight="confidence", least=5e-4)


@query(f"{G}, n as (select source as node from relationships union select target from relationships) select (select count(*) from n) as nodes, cast(0 as bigint) as unlabelled, cast(0 as bigint) as torn, true as beats_places")
def leiden_check(t):
    """What must hold of the last level: every node of an edge has one label, communities hang together, and modularity is above that of the places' labelling."""
    edges = fx.relationships(t)
    made = ld.leiden(edges, weight="confidence", least=5e-4)
    last = stage(made.where(F.col("level") == made.agg(F.max("level")).collect()[0][0]), "last")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    pieces = ld.split_apart(last.select("node", F.col("community").alias("c")), ld.symmetric(edges, "confidence"))
    places = fx.labels(t).where("level = 0").select(F.lit(-1).alias("level"), "node", "community").dropDuplicates(["node"])
    alone = nodes.join(places, "node", "left_anti").select(F.lit(-1).alias("level"), "node", F.col("node").alias("community"))
    q = {r["level"]: r["modularity"] for r in ld.modularity(edges, last.unionByName(places).unionByName(alone), weight="confidence").collect()}
    told = nodes.agg(F.count("*").alias("nodes")).join(nodes.join(last, "node", "left_anti").agg(F.count("*").alias("unlabelled")))
    torn = pieces.select("c").distinct().agg(F.count("*").alias("p")).join(last.select("community").distinct().agg(F.count("*").alias("q"))).select((F.col("p") - F.col("q")).alias("torn"))
    return told.join(torn).withColumn("beats_places", F.lit(max(v for k, v in q.items() if k >= 0) > q[-1]))


#: The change: each nation goes over to the next region.
MOVED = "moved as (select * from relationships where relation_type <> 'PART_OF' union all select concat('NATION_', cast(n_nationkey as varchar)), concat('REGION_', cast((n_regionkey + 1) % 5 as varchar)), 'PART_OF', cast(0.5 as double) + (n_nationkey % 50) / cast(100 as double) from nation)"
VALUES = """w as (select source, target, sum(confidence) as w from moved group by 1, 2), share as materialized (select source, target, w / sum(w) over (partition by source) as share from w),
 y(i, node, y) as (select 0, id, cast(0.15 as double) from entities union all select n.i + 1, n.node, 0.15 + coalesce(0.85 * f.flow, 0) from (select y.node, y.i from y) n left join (select s.target as node, sum(s.share * q.y) as flow from share s join y q on q.node = s.source group by 1) f on f.node = n.node where n.i < 30),
 last as (select node, y from y where i = 30)"""


def _changed(t):
    r = fx.relationships(t)
    state, whole = push.start(fx.entities(t).select("id"), r, left=1e-9)
    added = t.nation.select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("REGION_"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("target"), (F.lit(0.5) + (F.col("n_nationkey") % 50) / F.lit(100.0)).alias("confidence"))
    return state, whole, push.change(state, added, r.where("relation_type = 'PART_OF'"), left=1e-9)


@query(f"{G}, {MOVED}, {VALUES} select node, round(y / (select sum(y) from last), 8) as rank from last")
def pagerank_incremental(t):
    """Ranks after each nation has gone over to the next region, pushed from what changed; the SQL makes them from scratch."""
    return _changed(t)[0].ranks().select("node", F.round("rank", 8).alias("rank"))


@query(f"{G} select (select count(*) from entities) as touched_by_start, (select count(distinct id) from (select target as id from relationships where relation_type = 'PART_OF' union select source from relationships where relation_type = 'PART_OF') x) as touched_by_change")
def pagerank_incremental_report(t):
    """How many nodes the first run and the change have touched: all, and the nations and regions alone."""
    _, whole, later = _changed(t)
    most = lambda df, name: df.agg(F.max("touched").alias(name))
    return most(whole, "touched_by_start").join(most(later, "touched_by_change"))


@query()
def node2vec(t):
    """Embeddings of all entities by walks of ten nodes."""
    return walks.node2vec(fx.relationships(t), fx.entities(t).select("id"), length=10, each=2, window=3, p=0.5, q=2.0)


#: Each entity has the vector whose number is its own, modulo the number of vectors.
FEATURES = "f0 as materialized (select node, d, cast(embedding[d] as double) as x from (select e.id as node, v.embedding, unnest(range(1, len(v.embedding) + 1)) as d from entities e join embeddings v on v.vec_id = cast(regexp_extract(e.id, '[0-9]+$') as bigint) % (select count(*) from embeddings)) z), e as materialized (select source, target from relationships union select target, source from relationships)"


def _features(t):
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    own = fx.entities(t).select(F.col("id").alias("node"), F.pmod(F.regexp_extract("id", "[0-9]+$", 0).cast("long"), F.lit(vectors.count())).alias("vec_id"))
    r = fx.relationships(t).select("source", "target")
    return own.join(vectors, "vec_id").select("node", "vector"), r.union(r.select("target", "source")).toDF("source", "target")


def _sage_sql(near: str) -> str:
    layer = lambda i: f"w{i} as (select node, exp(sum(x)) as w from f{i} group by 1), n{i} as (select e.source as node, d, {near} as x from e join f{i} f on f.node = e.target join w{i} w on w.node = f.node group by 1, 2), f{i + 1} as materialized (select f.node, f.d, (f.x + coalesce(n.x, 0)) / 2 as x from f{i} f left join n{i} n on n.node = f.node and n.d = f.d)"
    return f"{G}, {FEATURES}, {layer(0)}, {layer(1)} select node, cast(d - 1 as integer) as place, round(x, 6) + cast(0 as double) as value from f2"  # no negative zeros


def _sage(t, kind: str):
    made = graph_features.graphsage(*_features(t), kind=kind, fan_out=(None, None))
    return made.select("node", F.posexplode("vector").alias("place", "value")).select("node", "place", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(_sage_sql("avg(f.x)"))
def graphsage_mean(t):
    return _sage(t, "mean")


@query(_sage_sql("max(f.x)"))
def graphsage_max(t):
    return _sage(t, "max")


@query(_sage_sql("sum(f.x * w.w) / sum(w.w)"))
def graphsage_attention(t):
    return _sage(t, "attention")


@query(_sage_sql("avg(f.x) * power(cast(0.9 as double), count(*) - 1)"))
def graphsage_fading(t):
    return _sage(t, "fading")


@query()
def graphsage_sampled(t):
    """With 25 and 10 neighbours; a test holds it against brute force."""
    return graph_features.graphsage(*_features(t))
