"""The knowledge graph that the relational tables stand for, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = [("region", "r_regionkey", "r_name", "REGION"), ("nation", "n_nationkey", "n_name", "NATION"), ("customer", "c_custkey", "c_name", "CUSTOMER"), ("supplier", "s_suppkey", "s_name", "SUPPLIER"), ("part", "p_partkey", "p_name", "PART")]

ENTITIES = "entities as (" + " union all ".join(f"select concat('{kind}_', cast({k} as varchar)) as id, {n} as name, '{kind}' as entity_type, cast(0.5 as double) + ({k} % 50) / cast(100 as double) as confidence from {t}" for t, k, n, kind in KINDS) + ")"

RELATIONSHIPS = """relationships as (
 select concat('CUSTOMER_', cast(c_custkey as varchar)) as source, concat('NATION_', cast(c_nationkey as varchar)) as target, 'LOCATED_IN' as relation_type, cast(0.5 as double) + (c_custkey % 50) / cast(100 as double) as confidence from customer
 union all select concat('SUPPLIER_', cast(s_suppkey as varchar)), concat('NATION_', cast(s_nationkey as varchar)), 'LOCATED_IN', cast(0.5 as double) + (s_suppkey % 50) / cast(100 as double) from supplier
 union all select concat('NATION_', cast(n_nationkey as varchar)), concat('REGION_', cast(n_regionkey as varchar)), 'PART_OF', cast(0.5 as double) + (n_nationkey % 50) / cast(100 as double) from nation
 union all select concat('SUPPLIER_', cast(l_suppkey as varchar)), concat('PART_', cast(l_partkey as varchar)), 'SUPPLIES', least(cast(1 as double), cast(0.5 as double) + count(*) / cast(20 as double)) from lineitem group by l_suppkey, l_partkey)"""

#: Places only: nations, regions and suppliers; small at every scale of the tables.
PLACES = """places as (select * from relationships where relation_type = 'PART_OF' or (relation_type = 'LOCATED_IN' and source like 'SUPPLIER_%'))"""

TIMED = """timed as (select concat('u', cast(user_id as varchar)) as source, event_type as target, event_type as edge_type, cast(floor(epoch_us(ts) / 1000000) as bigint) as at, value as weight from events)"""


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + "_"), F.col(column).cast("string"))


def _confidence(column: str):
    return F.lit(0.5) + (F.col(column) % 50) / F.lit(100.0)


def entities(t) -> DataFrame:
    out = None
    for table, k, n, kind in KINDS:
        part = getattr(t, table).select(_id(kind, k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("entity_type"), _confidence(k).alias("confidence"))
        out = part if out is None else out.union(part)
    return out


def relationships(t) -> DataFrame:
    edge = lambda df, s, k, d, o, kind: df.select(_id(s, k).alias("source"), _id(d, o).alias("target"), F.lit(kind).alias("relation_type"), _confidence(k).alias("confidence"))
    supplies = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    supplies = supplies.select(_id("SUPPLIER", "l_suppkey").alias("source"), _id("PART", "l_partkey").alias("target"), F.lit("SUPPLIES").alias("relation_type"), F.least(F.lit(1.0), F.lit(0.5) + F.col("n") / F.lit(20.0)).alias("confidence"))
    return edge(t.customer, "CUSTOMER", "c_custkey", "NATION", "c_nationkey", "LOCATED_IN").union(edge(t.supplier, "SUPPLIER", "s_suppkey", "NATION", "s_nationkey", "LOCATED_IN")).union(edge(t.nation, "NATION", "n_nationkey", "REGION", "n_regionkey", "PART_OF")).union(supplies)


def places(t) -> DataFrame:
    r = relationships(t)
    return r.where("relation_type = 'PART_OF' or (relation_type = 'LOCATED_IN' and source like 'SUPPLIER_%')")


def timed(t) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"), F.col("event_type").alias("edge_type"), at.alias("at"), F.col("value").alias("weight"))


# Questions that are put to the graph, by number.
QUESTIONS = [
    "What is NATION_3?", "Who is Supplier#000000001?", "What are the regions of NATION_1 and NATION_2?", "How is NATION_4 related to MIDDLE EAST?", "How are Supplier#000000002 connected to NATION_1?",
    "When did the red widget happen?", "Why did the blue bolt cause the hot gear?", "Compare NATION_1 and NATION_2 in terms of size", "compare red widget with blue bolt", "Give me an overview of all regions",
    "How many suppliers locate a widget?", "who is the customer because of whom the small ring came late, and when was it?", "What is the relationship between NATION_0 and AFRICA?", "Explain how a theory of truth and beauty differs from knowledge", "why does the supplier fail",
    "Summarize the main themes, broadly", "define gear; however, also tell me what is a bolt", "what is a widget and how is it related to a gear", "difference between small ring versus small gear", "find large important company people",
    "show total of hot gear before and after the war", "What caused the delay? Describe the reason, or the result", "region", "explain exactly the connection of \"NATION_5\" and \"AFRICA\" between them",
]
ASKED = "asked as (select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") v(ask_id, text))"


def asked(t) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(QUESTIONS)), "ask_id int, text string")


#: Relationships with what weighing and causal search need: a time, a causal strength for one type, a vector.
CAUSAL = """causal as (select r.*, case when relation_type = 'LOCATED_IN' then confidence end as causal_strength, 1700000000 - n * n * 500000 as moment, e.embedding from (select *, cast(round(confidence * 100) as bigint) as n from relationships) r left join embeddings e on e.vec_id = r.n)"""


def causal(t) -> DataFrame:
    n = F.round(F.col("confidence") * 100).cast("long")
    r = relationships(t).withColumn("n", n).join(F.broadcast(t.embeddings.where("vec_id between 0 and 100").select(F.col("vec_id").alias("n"), "embedding")), "n", "left")
    return r.withColumn("causal_strength", F.when(F.col("relation_type") == "LOCATED_IN", F.col("confidence"))).withColumn("at", 1700000000 - F.col("n") * F.col("n") * 500000)


#: Communities on two levels: a nation with its customers and suppliers, and a region with its nations' members.
LABELS = """labels as (select 0 as level, source as node, target as community from relationships where relation_type = 'LOCATED_IN' union all select 0, source, source from relationships where relation_type = 'PART_OF'
 union all select 1, a.source, b.target from relationships a join relationships b on a.target = b.source and a.relation_type = 'LOCATED_IN' and b.relation_type = 'PART_OF' union all select 1, source, target from relationships where relation_type = 'PART_OF' union all select distinct 1, target, target from relationships where relation_type = 'PART_OF')"""


def labels(t) -> DataFrame:
    r = relationships(t)
    at, of = r.where("relation_type = 'LOCATED_IN'"), r.where("relation_type = 'PART_OF'")
    row = lambda df, level, node, community: df.select(F.lit(level).alias("level"), F.col(node).alias("node"), F.col(community).alias("community"))
    up = at.select("source", F.col("target").alias("mid")).join(F.broadcast(of.select(F.col("source").alias("mid"), "target")), "mid")
    return row(at, 0, "source", "target").union(row(of, 0, "source", "source")).union(row(up, 1, "source", "target")).union(row(of, 1, "source", "target")).union(row(of, 1, "target", "target").distinct())
