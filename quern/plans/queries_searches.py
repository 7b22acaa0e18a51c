"""Searches by entity and community, and their fusion: each supplier is a question that names it and has a vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import searches
from quern.plans.queries_communities import _features
from quern.plans.registry import query
from quern.sources import fixtures as fx

_cos = lambda a, b: f"list_dot_product(cast({a} as double[]), cast({b} as double[])) / (sqrt(list_dot_product(cast({a} as double[]), cast({a} as double[]))) * sqrt(list_dot_product(cast({b} as double[]), cast({b} as double[]))))"
ASKS = f"""{fx.ENTITIES}, {fx.RELATIONSHIPS}, total as (select count(*) as n from embeddings), asks as (select 'ask_' || cast(s_suppkey as varchar) as ask_id, s_name as name, embedding as vector from supplier, total join embeddings on vec_id = s_suppkey % n),
 types as (select relation_type, embedding as of_type from (values ('LOCATED_IN', 0), ('PART_OF', 1), ('SUPPLIES', 2)) v(relation_type, k) join embeddings on vec_id = k)"""
CENTRIC = f"""named as (select ask_id, e.id, e.name, vector from asks join entities e on lower(e.name) = lower(asks.name)),
 centric as (select ask_id, id, name, cast(0.9 as double) as score, 'entity' as strategy from named union all
  select ask_id, target, e.name, max(round(0.7 * r.confidence * (1 + {_cos('vector', 'of_type')}), 6)), 'neighbour' from named join relationships r on r.source = named.id join types using (relation_type) join entities e on e.id = target group by 1, 2, 3)"""
COMMUNITY = f"""degree as (select source as id, count(*) as n from relationships group by 1), vec as (select e.id, e.name, v.embedding as x, 0.1 * coalesce(d.n, 0) as bonus from entities e join total on true join embeddings v on v.vec_id = cast(regexp_extract(e.id, '[0-9]+$') as bigint) % total.n left join degree d on d.id = e.id),
 community as (select ask_id, id, vec.name, round({_cos('vector', 'x')} + bonus, 6) as score, 'community' as strategy from asks, vec qualify row_number() over (partition by ask_id order by round({_cos('vector', 'x')} + bonus, 6) desc, id) <= 3)"""
FUSED = """every as (select ask_id, id, name, round(score * case strategy when 'entity' then 0.5 when 'neighbour' then 0.4 else 0.1 end, 6) as score from (select * from centric union all select * from community) x),
 one as (select ask_id, id, arg_max(name, score) as name, max(score) as score from every group by 1, 2), top as (select *, row_number() over (partition by ask_id order by score desc, id) as rn from one qualify rn <= 200),
 arr as materialized (select ask_id, list({'id': id, 'name': name, 'score': score} order by rn) as f from top group by 1),
 r(ask_id, i, taken, seen) as (select ask_id, 0, cast([] as bigint[]), cast([] as varchar[]) from arr union all
  select r.ask_id, i + 1, case when go then list_append(taken, cast(i + 1 as bigint)) else taken end, case when go then list_append(seen, nm) else seen end from (select r.*, f[i + 1].name as nm, len(taken) < 10 and (f[i + 1].score > 0.8 or not list_contains(seen, f[i + 1].name) or len(taken) < 5) as go from r join arr on arr.ask_id = r.ask_id where i < len(f)) r),
 done as (select r.ask_id, list_concat(taken, list_filter(range(1, len(f) + 1), lambda x: not list_contains(taken, x)))[1:10] as places, f from r join arr on arr.ask_id = r.ask_id where i = len(f)),
 fused as (select ask_id, unnest(range(len(places))) as place, f[unnest(places)] as x from done)"""


def _asks(t):
    n = t.embeddings.count()
    own = t.supplier.select(F.concat(F.lit("ask_"), F.col("s_suppkey").cast("string")).alias("ask_id"), F.col("s_name").alias("name"), F.pmod("s_suppkey", F.lit(n)).alias("vec_id"))
    kinds = F.when(F.col("vec_id") == 0, "LOCATED_IN").when(F.col("vec_id") == 1, "PART_OF").otherwise("SUPPLIES")
    types = t.embeddings.where("vec_id in (0, 1, 2)").select(kinds.alias("relation_type"), F.col("embedding").alias("vector"))
    return own.join(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id"), types


def _entities(t):
    return fx.entities(t).select("id", "name").join(_features(t)[0].withColumnRenamed("node", "id"), "id")


@query(f"with {ASKS}, {CENTRIC} select * from centric")
def entity_centric_search(t):
    asks, types = _asks(t)
    return searches.entity_centric(asks, fx.entities(t), fx.relationships(t), types)


@query(f"with {ASKS}, {COMMUNITY} select * from community")
def community_based_search(t):
    return searches.community_based(_asks(t)[0], _entities(t), fx.relationships(t))


@query(f"with recursive {ASKS}, {CENTRIC}, {COMMUNITY}, {FUSED} select ask_id, cast(place as integer) as place, x.id as id, x.score as score from fused")
def execute_adaptive(t):
    asks, types = _asks(t)
    return searches.execute_adaptive(asks, _entities(t), fx.relationships(t), types)
