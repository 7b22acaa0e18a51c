"""Traversal, ranking, community and corpus-graph queries over the whole graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import components, corpus, graph
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.sources import fixtures as fx

G = f"with recursive {fx.ENTITIES}, {fx.RELATIONSHIPS}"
PAIRS = "pairs as materialized (select distinct source, target from (select source, target from relationships union all select target, source from relationships) x where source <> target)"
NOW = 1767225600  # 2026-01-01


def _ids(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"{G} select e.id, e.name, r.target, f.name as target_name from relationships r join entities e on e.id = r.source join entities f on f.id = r.target")
def op_join_inner(t):
    e = fx.entities(t).select("id", "name")
    f = e.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return fx.relationships(t).join(e, F.col("id") == F.col("source")).join(f, "target").select("id", "name", "target", "target_name")


@query(f"{G} select a.id as a, b.id as b from entities a, entities b where a.entity_type = 'NATION' and b.entity_type = 'REGION'")
def op_join_cross(t):
    """Nations by regions: a cross join of two sides of fixed size, the one use that the algebra allows."""
    e = fx.entities(t)
    return e.where("entity_type = 'NATION'").select(F.col("id").alias("a")).crossJoin(F.broadcast(e.where("entity_type = 'REGION'").select(F.col("id").alias("b"))))


@query(f"{G} select source as id from relationships where relation_type = 'LOCATED_IN' intersect select source from relationships where relation_type = 'SUPPLIES'")
def op_intersect(t):
    r = fx.relationships(t)
    return r.where("relation_type = 'LOCATED_IN'").select(F.col("source").alias("id")).intersect(r.where("relation_type = 'SUPPLIES'").select("source"))


@query(f"{G} select id from entities except select source from relationships")
def op_except(t):
    return fx.entities(t).select("id").subtract(fx.relationships(t).select("source"))


@query(f"{G} select source as i, target as j, confidence as value from relationships")
def adjacency_matrix(t):
    return fx.relationships(t).select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("confidence").alias("value"))


@query(f"{G}, {PAIRS}, reach(node) as (select min(source) from pairs union select p.target from reach r join pairs p on p.source = r.node) select node, (select min(source) from pairs) as component from reach")
def connected_components(t):
    """All nodes that have an edge, by component; the SQL walks from the least node, all of one component here."""
    return components.connected_components(fx.relationships(t), "source", "target")


@query(f"""{G}, {PAIRS}, reach(node) as (select min(source) from pairs union select p.target from reach r join pairs p on p.source = r.node), k as (select count(*) as n from reach), i as (select count(*) as m from relationships)
 select 1 as components, k.n as largest, round(i.m / (2.0 * k.n), 6) as modularity from k, i""".replace("2.0 *", "cast(2 as double) *").replace("select 1 as", "select cast(1 as bigint) as"))
def detect_communities(t):
    """Components, the size of the largest, and edges inside by twice the number of nodes."""
    c = components.connected_components(fx.relationships(t), "source", "target").withColumnRenamed("component", "community")
    g = graph.incident(fx.relationships(t), c)
    return g.agg(F.count("*").alias("components"), F.max("members").alias("largest"), F.round(F.sum("inside") / (2.0 * F.sum("members")), 6).alias("modularity"))


def levels_sql(seeds: list[str], depth: int, pairs: str = "pairs", least: str = "") -> str:
    out = f"d0 as materialized (select unnest([{', '.join(repr(s) for s in seeds)}]) as node)"
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select node from d{i}" for i in range(k))
        out += f", d{k} as materialized (select distinct p.target as node from {pairs} p join d{k - 1} on p.source = d{k - 1}.node where p.target not in ({seen}))"
    return out + ", levels as (" + " union all ".join(f"select node, {k} as distance from d{k}" for k in range(depth + 1)) + ")"


@query(f"{G}, {PAIRS}, {levels_sql(['REGION_1'], 3)} select * from levels")
def bfs(t):
    """Undirected hops over edges of at least .5 confidence, three deep."""
    return graph.bfs(fx.relationships(t).where("confidence >= 0.5"), _ids(t, "REGION_1"), 3)


@query(f"{G}, {PAIRS}, {levels_sql(['SUPPLIER_3'], 3)} select * from levels")
def dfs(t):
    """What a depth-first walk of three hops reaches; the depth is the least one, which doesn't hang on the order."""
    return graph.bfs(fx.relationships(t), _ids(t, "SUPPLIER_3"), 3)


@query(f"{G}, {PAIRS}, {levels_sql(['NATION_2'], 1)} select source, target, relation_type from relationships where source in (select node from levels) and target in (select node from levels)")
def ego_network(t):
    return graph.ego_network(fx.relationships(t), _ids(t, "NATION_2"), 1).select("source", "target", "relation_type")


@query(f"{G}, {PAIRS}, {levels_sql(['REGION_0', 'NATION_7', 'PART_11'], 2)} select * from levels")
def multi_source_bfs(t):
    return graph.bfs(fx.relationships(t), _ids(t, "REGION_0", "NATION_7", "PART_11"), 2)


@query(f"{G}, {PAIRS}, {levels_sql(['PART_5', 'PART_6'], 2)} select r.source, r.target, r.relation_type, least(a.distance, b.distance) as distance from relationships r join levels a on a.node = r.source join levels b on b.node = r.target")
def query_focused_subgraph(t):
    """The edges between what lies near two entities that a question names, by distance."""
    r, near = fx.relationships(t), graph.bfs(fx.relationships(t), _ids(t, "PART_5", "PART_6"), 2)
    side = lambda c: near.select(F.col("node").alias(c), F.col("distance").alias(f"d_{c}"))
    return r.join(side("source"), "source").join(side("target"), "target").select("source", "target", "relation_type", F.least("d_source", "d_target").alias("distance"))


@query(f"{G}, edge as materialized (select distinct source, target from relationships), {levels_sql(['SUPPLIER_1', 'SUPPLIER_2'], 2, 'edge')} select node, distance as level from levels")
def expand_through_relationships(t):
    return graph.expand(fx.relationships(t), _ids(t, "SUPPLIER_1", "SUPPLIER_2"), 2)


@query(f"{G}, p(node, hops, path) as (select 'CUSTOMER_7', 0, 'CUSTOMER_7' union all select r.target, p.hops + 1, p.path || '>' || r.target from p join relationships r on r.source = p.node where p.hops < 4) select node, min(hops) as distance, arg_min(path, {{'h': hops, 'p': path}}) as path from p group by 1")
def relationship_path(t):
    """The path of fewest directed edges from an entity to each that it reaches."""
    return graph.hop_paths(fx.relationships(t), _ids(t, "CUSTOMER_7"), 4).select("node", "distance", F.array_join("path", ">").alias("path"))


@query(f"""{G} select a.source as start, b.target as node, a.source || '>' || a.target || '>' || b.target as path, round(a.confidence + b.confidence, 6) as weight from relationships a join relationships b on a.target = b.source where a.source <> b.target
 union all select source, target, source || '>' || target, round(confidence, 6) from relationships""")
def all_paths(t):
    """Simple directed paths of at most three nodes, from every node."""
    r = fx.relationships(t)
    return graph.simple_paths(r, r.select(F.col("source").alias("id")).distinct(), 3).select("start", "node", F.array_join("path", ">").alias("path"), F.round("weight", 6).alias("weight"))


@query(f"""{G}, p(node, path, d) as (select 'NATION_2', ['NATION_2'], cast(0 as double) union all select x.target, list_append(p.path, x.target), p.d + x.confidence from p join (select source, target, confidence from relationships union all select target, source, confidence from relationships) x on x.source = p.node where len(p.path) < 4 and not list_contains(p.path, x.target))
 select 'NATION_2' as source, node as target, array_to_string(path, '>') as path, round(d, 6) as weight from p where node in ('NATION_3', 'REGION_2', 'PART_4')""")
def find_all_paths(t):
    """Simple undirected paths of at most four nodes from one entity to three others."""
    r = fx.relationships(t).select("source", "target", "confidence")
    both = r.union(r.select("target", "source", "confidence"))
    p = graph.simple_paths(both, _ids(t, "NATION_2"), 4).where(F.col("node").isin("NATION_3", "REGION_2", "PART_4"))
    return p.select(F.col("start").alias("source"), F.col("node").alias("target"), F.array_join("path", ">").alias("path"), F.round("weight", 6).alias("weight"))


def relaxed_sql(start: str, rounds: int) -> str:
    out = f"step as materialized (select source, target, min(confidence) as w from (select source, target, confidence from relationships union all select target, source, confidence from relationships) x group by 1, 2), s0 as materialized (select '{start}' as node, cast(0 as double) as d)"
    for k in range(1, rounds + 1):
        out += f", s{k} as materialized (select node, min(d) as d from (select * from s{k - 1} union all select t.target, s.d + t.w from s{k - 1} s join step t on t.source = s.node) x group by 1)"
    return out + f" select node, round(d, 6) as distance from s{rounds}"


@query(f"{G}, {relaxed_sql('REGION_2', 10)}")
def shortest_path(t):
    """From one node to all, over all edges; costs are confidences, so surer edges are longer."""
    return graph.shortest_paths(fx.relationships(t), _ids(t, "REGION_2")).select("node", F.round("distance", 6).alias("distance"))


TREE = f"""{G}, {fx.PLACES}, step as materialized (select source, target, confidence as w from places union all select target, source, confidence from places),
 p(start, node, prev, d, path) as (select node, node, '', cast(0 as double), [node] from (select distinct source as node from step) z union all select p.start, s.target, p.node, p.d + s.w, list_append(p.path, s.target) from p join step s on s.source = p.node and s.target <> p.prev)"""


@query(f"{TREE} select start as node, count(*) as reachable, round(count(*) / sum(d), 6) as closeness from p where d > 0 group by 1")
def closeness(t):
    """Of every place, over the graph of places (it has one path between two, by which the SQL finds them)."""
    return graph.closeness_of_all(fx.places(t))


@query(f"{TREE}, i as (select unnest(path[2:len(path) - 1]) as node from p where len(path) > 2), n as (select count(distinct node) as n from p) select node, count(*) as paths, round(count(*) / ((n - 1) * (n - 2) / cast(2 as double)), 6) as betweenness from i, n group by node, n")
def betweenness(t):
    return graph.betweenness_of_all(fx.places(t))


def pagerank_sql(seed: str, damping: float = 0.85, nodes: str = "select id as node from entities", edges: str = "relationships") -> str:
    """PageRank by recursion over rounds, to the same tolerance."""
    return f"""nodes as materialized ({nodes}), w as (select source, target, sum(confidence) as w from {edges} group by 1, 2), share as materialized (select source, target, w / sum(w) over (partition by source) as share from w),
 base as materialized (select node, {seed} as r, node in (select source from share) as has_out from nodes),
 pr(i, node, r, has_out, rank, moved) as (select 0, node, r, has_out, r, cast(1 as double) from base union all select p.i + 1, p.node, p.r, p.has_out, x.rank, abs(x.rank - p.rank) from pr p join
 (select b.node, {1 - damping} * b.r + {damping} * (coalesce(f.flow, 0) + l.lost * b.r) as rank from base b left join (select s.target as node, sum(s.share * q.rank) as flow from share s join pr q on q.node = s.source group by 1) f on f.node = b.node, (select coalesce(sum(rank), 0) as lost from pr where not has_out) l) x on x.node = p.node
 where p.i < 100 and (select max(moved) from pr) >= 1e-6), ranks as (select node, rank from pr where i = (select max(i) from pr))"""


EVEN = "1 / cast((select count(*) from nodes) as double)"
PPR_SEED = "case when node = 'NATION_1' then 0.75 when node = 'NATION_4' then 0.25 else cast(0 as double) end"


def _nodes(t):
    return fx.entities(t).select("id")


@query(f"{G}, {pagerank_sql(EVEN)} select node, round(rank, 8) as rank from ranks")
def pagerank(t):
    return graph.pagerank(_nodes(t), fx.relationships(t)).select("node", F.round("rank", 8).alias("rank"))


@query(f"{G}, {pagerank_sql(PPR_SEED)} select node, round(rank, 8) as rank from ranks")
def pagerank_personalised(t):
    seeds = t.spark.createDataFrame([("NATION_1", 3.0), ("NATION_4", 1.0)], "id string, p double")
    return graph.pagerank(_nodes(t), fx.relationships(t), seeds).select("node", F.round("rank", 8).alias("rank"))


@query(f"{G}, hit as (select id, case when lower(name) = 'red widget' then cast(1 as double) else 0.8 end as p from entities where contains(lower(name), 'red widget')), {pagerank_sql('coalesce((select p from hit where hit.id = node), 0) / (select sum(p) from hit)')} select node, round(rank, 8) as rank from ranks order by 2 desc, 1 limit 10")
def pagerank_quick(t):
    """Seeds are entities whose name has the words: 1 if it is them, .8 otherwise."""
    e = fx.entities(t).where("contains(lower(name), 'red widget')")
    seeds = e.select("id", F.when(F.lower("name") == "red widget", 1.0).otherwise(0.8).alias("p"))
    return graph.pagerank(_nodes(t), fx.relationships(t), seeds).select("node", F.round("rank", 8).alias("rank")).orderBy(F.desc("rank"), "node").limit(10)


WORDSET = "list_distinct(list_filter(string_split_regex(lower(name || ' ' || entity_type), '[ ]+'), x -> x <> ''))"
JACCARD = f"len(list_intersect({WORDSET}, ['blue', 'bolt', 'part'])) / cast(len(list_distinct(list_concat({WORDSET}, ['blue', 'bolt', 'part']))) as double)"


@query(f"{G}, hit as (select id, {JACCARD} as p from entities where {JACCARD} > 0.1), tot as (select sum(p) as s from hit), {pagerank_sql('coalesce(h.p, 0) / (select s from tot)').replace('from nodes),', 'from nodes left join hit h on h.id = node),')} select node, round(rank, 8) as rank from ranks order by 2 desc, 1 limit 10")
def pagerank_retrieval(t):
    """Seeds by the words that a question shares with name and type."""
    return rt.pagerank_retrieval(fx.entities(t), fx.relationships(t), "blue bolt part")


@query(f"""{G}, fact as materialized (select source, target, confidence as score from relationships where relation_type = 'SUPPLIES' order by confidence desc, source, target limit 5), passage as materialized (select id, confidence as score from entities where entity_type = 'NATION'),
 near as (select source as id, count(distinct target) as n from relationships where target like 'NATION_%' group by 1), ends as (select source as id, score from fact union all select target, score from fact), ew as (select e.id, avg(e.score / greatest(coalesce(n.n, 0), 1)) as w from ends e left join near n on n.id = e.id group by 1),
 en as (select id, case when (select max(w) - min(w) from ew) > 0 then (w - (select min(w) from ew)) / (select max(w) - min(w) from ew) else 1 end as w from ew), pw as (select id, score * 0.05 as w from passage), pn as (select id, (w - (select min(w) from pw)) / (select max(w) - min(w) from pw) as w from pw),
 seed as materialized (select id, sum(w) as w from (select * from en union all select * from pn) x group by 1), tot as (select sum(w) as s from seed), {pagerank_sql('coalesce(h.w, 0) / (select s from tot)', 0.5).replace('from nodes),', 'from nodes left join seed h on h.id = node),')}
 select node, round(rank, 8) as score from ranks where node in (select id from passage) order by 2 desc, 1 limit 10""")
def hipporag(t):
    """Facts are the five surest supplies, passages the nations."""
    r, e = fx.relationships(t), fx.entities(t)
    facts = r.where("relation_type = 'SUPPLIES'").orderBy(F.desc("confidence"), "source", "target").limit(5).select("source", "target", F.col("confidence").alias("score"))
    passages = e.where("entity_type = 'NATION'").select("id", F.col("confidence").alias("score"))
    near = r.where(F.col("target").like("NATION_%")).groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n"))
    return rt.hipporag(_nodes(t), r, facts, passages, near)


@query(f"{G} select source, target as other, round(0.8 * confidence, 6) as score, 'direct' as how from relationships union all select a.source, b.source, round(0.6 * a.confidence * b.confidence, 6), 'common' from relationships a join relationships b on a.target = b.target and a.source < b.source and a.relation_type = 'PART_OF' and b.relation_type = 'PART_OF'")
def find_entity_paths(t):
    """Direct edges, and pairs with a common neighbour among the edges of one type."""
    r = fx.relationships(t)
    return rt.entity_paths(r, r.where("relation_type = 'PART_OF'"))


@query(f"{G}, {fx.CAUSAL}, q as (select embedding as qe from embeddings where vec_id = 7), c as (select c.*, case when c.embedding is null then cast(0 as double) else greatest(0, list_dot_product(cast(c.embedding as double[]), cast(qe as double[])) / (sqrt(list_dot_product(cast(c.embedding as double[]), cast(c.embedding as double[]))) * sqrt(list_dot_product(cast(qe as double[]), cast(qe as double[]))))) end as alike, abs({NOW} - moment) // 31536000 as years from causal c, q) select source, target, relation_type, round(confidence * (1 + alike + case when years <= 10 then cast(0.3 as double) when years <= 50 then 0.3 * (1 - (years - 10) / cast(40 as double)) when years <= 200 then 0.1 * (1 - (years - 50) / cast(150 as double)) else 0.05 end + 0.15 * (case when contains(lower(relation_type), 'part') then 1 else 0 end + case when contains(lower(relation_type), 'supplies') then 1 else 0 end) + 0.2 * coalesce(causal_strength, 0)), 6) as weight from c")
def dynamic_weight(t):
    from quern.plans.queries_retrieval import query_vector

    return graph.dynamic_weight(fx.causal(t), query_vector(t), ["Part", "supplies"], NOW).select("source", "target", "relation_type", "weight")


@query(f"""{G}, {fx.CAUSAL}, c as (select source, target, confidence * case when causal_strength is null then 0.7 else 0.5 + 0.5 * causal_strength end as c, causal_strength is not null as cause, moment from causal where confidence >= 0.3)
 select source as start, target as node, source || '>' || target as path, round(c, 6) as confidence, true as consistent, cast(0 as bigint) as span from c where cause
 union all select a.source, b.target, a.source || '>' || a.target || '>' || b.target, round(a.c * b.c, 6), b.moment >= a.moment, b.moment - a.moment from c a join c b on a.target = b.source where a.cause or b.cause""")
def causal_chains(t):
    """Chains over all edges; none has more than two steps here."""
    r = fx.causal(t)
    return graph.causal_chains(r, r.select(F.col("source").alias("id")).distinct(), 4)


# communities ----------------------------------------------------------------------------------------------------
@query(f"{G}, {fx.LABELS} select level, community, count(*) as members from labels group by 1, 2")
def community_members(t):
    return fx.labels(t).groupBy("level", "community").agg(F.count("*").alias("members"))


def _summary_sql(level: int) -> str:
    return f"""{G}, {fx.LABELS}, m as (select l.community, e.* from labels l join entities e on e.id = l.node where level = {level}), b as (select *, row_number() over (partition by community, entity_type order by confidence desc, id) as rn from m),
 k as (select community, entity_type, count(*) as n, sum(cast(confidence as decimal(18, 6))) as c, entity_type || ': ' || string_agg(name, ', ' order by rn) filter (rn <= 5) as line from b group by 1, 2),
 sm as (select community, cast(sum(n) as bigint) as members, round(cast(sum(c) as double) / cast(sum(n) as double), 6) as mean_confidence, string_agg(entity_type, ',' order by entity_type) as types, 'Contains ' || cast(cast(sum(n) as bigint) as varchar) || ' entities. ' || string_agg(line, '; ' order by line) as summary from k group by 1)"""


@query(f"{_summary_sql(0)} select * from sm")
def community_summaries(t):
    return graph.community_summaries(fx.entities(t), fx.labels(t).where("level = 0").select("node", "community"))


@query(f"{_summary_sql(1)} select * from sm")
def community_stats(t):
    return graph.community_summaries(fx.entities(t), fx.labels(t).where("level = 1").select("node", "community"))


@query(f"{G}, {fx.LABELS}, a as (select * from labels where level = 0), i as (select x.community, count(*) as inside from relationships r join a x on x.node = r.source join a y on y.node = r.target and y.community = x.community group by 1), n as (select community, count(*) as members from a group by 1) select n.community, members, coalesce(inside, 0) as inside from n left join i using (community)")
def community_context(t):
    """How many edges lie inside each community."""
    return graph.incident(fx.relationships(t), fx.labels(t).where("level = 0").select("node", "community"))


@query(f"{G}, {fx.LABELS} select distinct l.level, l.community from labels l join entities e on e.id = l.node where l.level = 1 and contains(lower(e.name), 'nation_1')")
def community_retrieve(t):
    """Communities of a level that have a member whose name holds the question's word."""
    e = fx.entities(t).where("contains(lower(name), 'nation_1')").select(F.col("id").alias("node"))
    return fx.labels(t).where("level = 1").join(e, "node", "left_semi").select("level", "community").distinct()


@query()
def label_communities(t):
    """Deterministic label moves over the whole graph; tests compare their modularity with that of single nodes."""
    return graph.label_communities(fx.relationships(t), 6)


# the corpus graph: names of the parts as global entities, orders as documents ---------------------------------------
MENTION = "m as (select l_orderkey as doc, lower(p_name) as name from lineitem join part on p_partkey = l_partkey)"
GLOBAL = f"{MENTION}, g as (select name, count(distinct doc) as documents, count(*) as mentions from m group by 1), gi as (select *, round((0.4 * (ln(documents) + 1) + 0.3 * (ln(mentions) + 1) + 0.3 * documents) / 3, 6) as importance from g)"
CO = f"{MENTION}, dm as (select distinct doc, name from m), co as (select a.name as source, b.name as target, count(*) as documents, round(least(cast(1 as double), 0.7 + 0.1 * (count(*) - 1)), 6) as confidence from dm a join dm b on a.doc = b.doc and a.name < b.name group by 1, 2)"


def _mentions(t):
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name")), "l_partkey").select("doc", "name")


@query(f"with {GLOBAL} select name, documents, mentions, importance from gi")
def entity_importance(t):
    return corpus.global_entities(_mentions(t))


@query(f"with {CO} select * from co")
def corpus_graph_build(t):
    return corpus.co_occurrences(_mentions(t))


@query(f"with {GLOBAL} select name, importance from gi where contains(name, 'red') order by importance desc, name limit 10")
def corpus_query(t):
    return corpus.global_entities(_mentions(t)).where("contains(name, 'red')").select("name", "importance").orderBy(F.desc("importance"), "name").limit(10)


@query(f"with {GLOBAL} select name, importance from gi where documents > 1 order by importance desc, name limit 20")
def corpus_cross_document(t):
    """The most important entities of several documents."""
    return corpus.global_entities(_mentions(t)).where("documents > 1").select("name", "importance").orderBy(F.desc("importance"), "name").limit(20)


@query(f"with {CO}, b as (select source, target from co union all select target, source from co), s as (select min(name) as name from m), one as (select distinct target as name from b where source = (select name from s)), two as (select distinct target as name from b where source in (select name from one)) select name, min(level) as level from (select name, 0 as level from s union all select name, 1 from one union all select name, 2 from two) x group by 1")
def corpus_related(t):
    """What is within two co-occurrences of the first entity."""
    co = corpus.co_occurrences(_mentions(t))
    first = _mentions(t).agg(F.min("name").alias("id"))
    return graph.bfs(co, first, 2).select(F.col("node").alias("name"), F.col("distance").alias("level"))


@query(f"""with {CO}, n as (select count(distinct name) as n, count(distinct doc) as docs from m), e as (select count(*) as e, avg(confidence) as c from co) select n as entities, e as relations, round(2 * e / cast(n as double), 6) as mean_connections, round(2 * e / (cast(n as double) * (n - 1)), 6) as density, round(0.3 * least(cast(1 as double), 2 * e / cast(n as double) / 10) + 0.3 * c + 0.4 * least(cast(1 as double), n / cast(docs as double)), 6) as quality from n, e""")
def corpus_stats(t):
    return corpus.statistics(_mentions(t))


CLUSTER_PATTERNS = ["\\b[A-Z][a-z]+ [a-z]+\\b", "\\b[A-Z][A-Z]+ [A-Z]+\\b", "\\b\\w+ system\\b", "\\b\\w+ process\\b", "\\b\\w+ method\\b"]


@query()
def cluster_concepts(t):
    """Phrases of five patterns, grouped in lower case."""
    return corpus.clusters(t.documents, CLUSTER_PATTERNS)


@query(f"{G}, d as (select node, count(*) as degree from (select source as node from relationships union all select target from relationships) x group by 1) select (select count(*) from entities) as nodes, (select count(*) from relationships) as edges, round(avg(degree), 6) as mean_degree, max(degree) as max_degree, (select count(*) from entities) - count(*) as isolated from d")
def incremental_statistics(t):
    n, e = fx.entities(t).agg(F.count("*").alias("nodes")), fx.relationships(t).agg(F.count("*").alias("edges"))
    d = graph.degrees(fx.relationships(t)).agg(F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.count("*").alias("with"))
    return n.join(e).join(d).select("nodes", "edges", "mean_degree", "max_degree", (F.col("nodes") - F.col("with")).alias("isolated"))


# anchors -----------------------------------------------------------------------------------------------------------
CONCEPTS = ["nation", "bolt", "supplies", "customer"]
ANCHORS = f"""c as (select unnest([{', '.join(repr(c) for c in CONCEPTS)}]) as concept), h as (select concept, id, confidence from c, entities e where contains(lower(e.name), concept) or exists (select 1 from relationships r where r.source = e.id and contains(lower(r.relation_type), concept))),
 k as (select *, row_number() over (partition by concept order by id) as rn from h), a as (select concept, count(*) as n, round(0.4 * least(count(*) / cast(10 as double), 1) + 0.6 * avg(confidence), 6) as relevance from k where rn <= 10 group by 1), an as (select * from a where relevance >= 0.3 order by relevance desc, concept limit 5), ae as (select k.id, an.relevance from k join an using (concept) where rn <= 10)"""


@query(f"{G}, {ANCHORS} select concept, n, relevance from an")
def symbolic_anchors(t):
    return rt.symbolic_anchors(CONCEPTS, fx.entities(t), fx.relationships(t))[0]


@query(f"{G}, {ANCHORS}, rs as (select target as id, max(confidence) as score from relationships group by 1), m as (select r.target as id, r.source as entity, avg(ae.relevance) as b from relationships r join ae on ae.id = r.source group by 1, 2), b as (select id, avg(b) as boost from m group by 1) select rs.id, round(score * (1 + coalesce(boost, 0)), 6) as score from rs left join b on b.id = rs.id")
def anchor_boost(t):
    """Results are the targets of relationships, their entities the sources."""
    grounded = rt.symbolic_anchors(CONCEPTS, fx.entities(t), fx.relationships(t))[1]
    r = fx.relationships(t)
    return rt.anchor_boost(r.groupBy(F.col("target").alias("id")).agg(F.max("confidence").alias("score")), r.select(F.col("target").alias("id"), F.col("source").alias("entity")).distinct(), grounded)


# temporal ----------------------------------------------------------------------------------------------------------
START, STEP = 1704067200, 86400
T = f"{fx.TIMED}, iv as (select *, at as start_at, at + (at % 24) * 3600 as end_at from timed)"


def _intervals(t):
    return fx.timed(t).withColumn("start_at", F.col("at")).withColumn("end_at", F.col("at") + (F.col("at") % 24) * 3600)


@query(f"with {T}, b as (select distinct node from (select source as node from iv where {START + 900000} between start_at and end_at union all select target from iv where {START + 900000} between start_at and end_at) x), a as (select distinct node from (select source as node from iv where {START + 1500000} between start_at and end_at union all select target from iv where {START + 1500000} between start_at and end_at) x) select coalesce(b.node, a.node) as node, case when b.node is null then 'added' when a.node is null then 'removed' else 'stable' end as change from b full join a on a.node = b.node")
def node_churn(t):
    """Between the snapshots at two moments."""
    from quern.operators import temporal

    nodes = lambda at: temporal.snapshot_at(_intervals(t), at).select(F.explode(F.array("source", "target")).alias("node"))
    return temporal.churn(nodes(START + 900000), nodes(START + 1500000))


@query(f"with {T}, w as (select cast(floor((at - {START}) / cast({STEP} as double)) as bigint) as k, source, target from iv), n as (select k, count(distinct node) as n from (select k, source as node from w union all select k, target from w) x group by 1), d as (select k, node, count(*) as d from (select k, source as node from w union all select k, target from w where target <> source) x group by 1, 2) select d.k as day, d.node, round(d.d / cast(n.n - 1 as double), 6) as centrality from d join n using (k) where n.n > 1")
def temporal_centrality(t):
    """Degree of each node by day, over the other nodes of that day."""
    w = fx.timed(t).select(F.floor((F.col("at") - START) / STEP).alias("day"), "source", "target")
    ends = w.select("day", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    n = ends.groupBy("day").agg(F.countDistinct("node").alias("n"))
    return ends.groupBy("day", "node").agg(F.count("*").alias("d")).join(F.broadcast(n), "day").where("n > 1").select("day", "node", F.round(F.col("d") / (F.col("n") - 1), 6).alias("centrality"))


@query(f"with {T}, s as (select * from iv where {START + 900000} between start_at and end_at), n as (select count(distinct node) as n from (select source as node from s union all select target from s) x) select n as nodes, (select count(*) from s) as edges, round((select count(*) from s) / (n * (n - 1) / cast(2 as double)), 6) as density from n")
def snapshot_density(t):
    from quern.operators import temporal

    s = temporal.snapshot_at(_intervals(t), START + 900000)
    n = s.select(F.explode(F.array("source", "target")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    return n.join(s.agg(F.count("*").alias("edges"))).select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2.0), 6).alias("density"))


@query(f"with {T} select source, target, at, end_at - start_at as duration, start_at <= {START + 172800} and end_at >= {START + 86400} as overlaps, {START + 100000} between start_at and end_at as contains from iv where edge_type in ('click', 'view')")
def temporal_relations(t):
    """Duration, overlap with a range and containment of a moment, for edges of two types (the query's filter)."""
    e = _intervals(t).where("edge_type in ('click', 'view')")
    return e.select("source", "target", "at", (F.col("end_at") - F.col("start_at")).alias("duration"), ((F.col("start_at") <= START + 172800) & (F.col("end_at") >= START + 86400)).alias("overlaps"), F.lit(START + 100000).between(F.col("start_at"), F.col("end_at")).alias("contains"))


@query(f"with {T} select a.source, a.at as a_at, b.at as b_at, count(*) as n from iv a join iv b on a.source = b.source and a.start_at <= b.end_at and b.start_at <= a.end_at and (a.at < b.at or (a.at = b.at and a.edge_type < b.edge_type)) group by 1, 2, 3")
def interval_overlap_join(t):
    """Overlapping edges of one source: intervals meet by the days that they touch, and count on the first they share."""
    from quern.operators import temporal

    return temporal.overlapping(_intervals(t)).groupBy("source", F.col("at").alias("a_at"), "b_at").agg(F.count("*").alias("n"))


@query(f"with {T}, p as (select event_id, 'u' || cast(user_id as varchar) as source, cast(floor(epoch_us(ts) / 1000000) as bigint) as at from events where event_type = 'purchase'), c as (select 'u' || cast(user_id as varchar) as source, cast(floor(epoch_us(ts) / 1000000) as bigint) as at from events where event_type = 'click') select event_id, p.source, p.at, max(c.at) as last_click from p left join c on c.source = p.source and c.at <= p.at group by 1, 2, 3")
def as_of_join(t):
    """For each purchase, the user's last click before it: one window over both, no join by range."""
    from quern.operators import temporal

    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    e = t.events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), at.alias("at"), "event_type")
    return temporal.as_of(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'click'").select("source", F.col("at").alias("last_click")), "source", "at", "last_click")


# deltas -------------------------------------------------------------------------------------------------------------
BEFORE = "eb as (select event_id as id, user_id as source, event_type as target, value as weight from events), ea as (select id + case when id % 5 = 0 then 100000000 else 0 end as id, source, target, weight + case when id % 11 = 0 then 1 else 0 end as weight from eb where id % 7 <> 0)"
DELTA = f"{BEFORE}, dl as (select coalesce(b.id, a.id) as id, case when b.id is null then 'added' when a.id is null then 'removed' when a.weight <> b.weight then 'modified' end as change from eb b full join ea a on a.id = b.id)"


def _edges_before_after(t):
    b = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("target"), F.col("value").alias("weight"))
    a = b.where("id % 7 <> 0").select((F.col("id") + F.when(F.col("id") % 5 == 0, 100000000).otherwise(0)).alias("id"), "source", "target", (F.col("weight") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("weight"))
    return b, a


@query(f"with {DELTA} select id, change from dl where change is not null")
def snapshot_delta_edges(t):
    from quern.operators import temporal

    b, a = _edges_before_after(t)
    return temporal.delta(b, a, "id", ["source", "target", "weight"])


@query(f"with {DELTA} select change, count(*) as n, round(100 * count(*) / cast((select count(*) from eb) + (select count(*) from ea) as double), 6) as percent from dl where change is not null group by 1")
def delta_change_percent(t):
    from quern.operators import temporal

    b, a = _edges_before_after(t)
    total = b.select("id").unionAll(a.select("id")).agg(F.count("*").alias("total"))
    return temporal.delta(b, a, "id", ["source", "target", "weight"]).groupBy("change").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("change", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


@query(f"{G}, ch as (select id as entity, cast(null as varchar) as source, cast(null as varchar) as target from entities where confidence >= 0.97 union all select null, source, target from relationships where confidence >= 0.98) select region, strategy, priority, count(*) as n from (select entity as region, 'Relational' as strategy, 2 as priority from ch where entity is not null union all select source, 'Relational', 1 from ch where source is not null union all select target, 'Relational', 1 from ch where target is not null) x group by 1, 2, 3")
def cache_invalidation(t):
    """What changes of entities (2) and relationships (1, both ends) make stale."""
    e = fx.entities(t).where("confidence >= 0.97").select(F.col("id").alias("region"), F.lit(2).alias("priority"))
    r = fx.relationships(t).where("confidence >= 0.98").select(F.explode(F.array("source", "target")).alias("region"), F.lit(1).alias("priority"))
    return e.union(r).groupBy("region", F.lit("Relational").alias("strategy"), "priority").agg(F.count("*").alias("n"))


@query(f"{G}, k as (select id, entity_type, confidence, row_number() over (partition by entity_type order by confidence desc, id) as rn from entities) select id, entity_type, rn as place from k where rn <= case entity_type when 'CUSTOMER' then 5 when 'PART' then 3 else 2 end")
def top_k_per_group(t):
    """A quota for each type."""
    w = Window.partitionBy("entity_type").orderBy(F.desc("confidence"), "id")
    quota = F.when(F.col("entity_type") == "CUSTOMER", 5).when(F.col("entity_type") == "PART", 3).otherwise(2)
    return fx.entities(t).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= quota).select("id", "entity_type", "place")
