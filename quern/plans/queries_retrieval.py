"""Retrieval, fusion, vector, query-understanding and answer queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vector as vx
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.sources import fixtures as fx

STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
TOKENS = f"""tok as (select doc_id, token as term from (select doc_id, regexp_replace(unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+')), '[^\\p{{L}}\\p{{N}}]', '', 'g') as token from documents) x where strlen(token) > 2 and token not in {STOP}),
 len as (select doc_id, count(*) as length from tok group by 1), docs as (select count(*) as n from documents), mean as (select sum(length) / cast((select n from docs) as double) as m from len)"""
TERMS = ["thea", "andth", "ention", "ciónas", "thea"]


def bm25_sql(terms: list[str], k: str = "order by 2 desc, 1 limit 10") -> str:
    want = " union all ".join(f"select '{t}' as term, {terms.count(t)} as w" for t in dict.fromkeys(terms))
    return f"""{TOKENS}, want as ({want}), tf as (select doc_id, term, count(*) as n from tok where term in (select term from want) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
 bm25 as (select tf.doc_id, round(sum(want.w * (ln((select n from docs) / cast(df.df as double)) + 1) * (tf.n / cast(len.length as double)) * 2.2 / (tf.n / cast(len.length as double) + 1.2 * (1 - 0.75 + 0.75 * len.length / (select m from mean)))), 6) as score
 from tf join df using (term) join want using (term) join len using (doc_id) group by 1 {k})"""


@query(f"with {bm25_sql(TERMS)} select doc_id, score from bm25")
def bm25_search(t):
    return rt.bm25_search(t.documents, TERMS)


@query(f"with {bm25_sql(['thea', 'ention'])} select doc_id, score from bm25")
def bm25_index_search(t):
    """The same from a stored index, whose postings of other terms aren't read."""
    return rt.Index.build(t.documents).search(["thea", "ention"])


@query(f"with {TOKENS} select (select n from docs) as documents, round((select m from mean), 6) as mean_length, (select count(distinct term) from tok) as terms")
def bm25_stats(t):
    return rt.Index.build(t.documents).stats()


@query(f"with {TOKENS} select tok.doc_id, term, count(*) as n, any_value(length) as length from tok join len on len.doc_id = tok.doc_id group by 1, 2")
def bm25_index(t):
    return rt.Index.build(t.documents).postings.select("doc_id", "term", "n", F.col("length").cast("long").alias("length"))


@query(f"with {TOKENS} select term, count(*) as n, count(distinct doc_id) as df from tok group by 1")
def bm25_terms(t):
    return rt.Index.build(t.documents).terms()


COS = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))))"


def query_vector(t, i: int = 7):
    row = t.embeddings.where(F.col("vec_id") == i).select("embedding").head()
    return list(row[0]) if row else []


@query(f"select a.vec_id, round({COS}, 6) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b order by 2 desc, 1 limit 10")
def vector_search(t):
    return rt.vector_search(t.embeddings, query_vector(t))


@query(f"select * from (select a.vec_id, round({COS}, 6) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b) x where score >= 0.3")
def find_similar(t):
    return rt.vector_search(t.embeddings, query_vector(t), k=None, least=0.3)


@query(f"""select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from
 (select b.vec_id as query_id, a.vec_id, round({COS}, 6) as score from embeddings a join embeddings b on b.vec_id % 20 = 0 and a.vec_id <> b.vec_id) x) y where rank <= 10""")
def batch_search(t):
    return rt.batch_search(t.embeddings, t.embeddings.where("vec_id % 20 = 0")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""select * from (select query_id as source, vec_id as target, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from
 (select b.vec_id as query_id, a.vec_id, round({COS}, 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id) x) y where rank <= 5) z where score > 0.1""")
def semantic_connections(t):
    return rt.similar_pairs(t.embeddings, "vec_id", "embedding", 0.1, 5).select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), "score")


@query("""select count(*) as n, min(len(embedding)) as dims, round(min(v), 6) as least, round(max(v), 6) as most, round(avg(v), 6) as mean from (select embedding, sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as v from embeddings) x""")
def vector_statistics(t):
    return t.embeddings.select("embedding", vx.norm(F.col("embedding")).alias("v")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.round(F.avg("v"), 6).alias("mean"))


@query("select label, i as at, round(avg(x), 5) as value from (select label, unnest(cast(embedding as double[])) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) y group by 1, 2")
def centroid(t):
    return t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", (F.col("i") + 1).cast("long").alias("at")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("value"))


HYBRID = ["thea", "ention", "ciónas"]


def _lists(t, k: int = 100):
    """A lexical list of documents and a list by vectors; the vector of a document has its id."""
    a = rt.bm25_search(t.documents, HYBRID, k=k).withColumnRenamed("doc_id", "id")
    b = rt.vector_search(t.embeddings, query_vector(t), k=k).withColumnRenamed("vec_id", "id")
    return a, b


LISTS = f"""{bm25_sql(HYBRID, 'order by 2 desc, 1 limit 100')}, l2 as (select a.vec_id as id, round({COS}, 6) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b order by 2 desc, 1 limit 100),
 a as (select doc_id as id, score, row_number() over (order by score desc, doc_id) - 1 as rank from bm25), b as (select id, score, row_number() over (order by score desc, id) - 1 as rank from l2)"""


def lists_sql(body: str) -> str:
    return f"with {LISTS} {body}"


@query(lists_sql("select id, round(sum(s), 6) as score from (select id, 0.7 / (60 + rank + 1) as s from a union all select id, 0.3 / (60 + rank + 1) from b) x group by id order by 2 desc, 1 limit 10"))
def hybrid_rrf(t):
    return rt.fuse([*_lists(t)], [0.7, 0.3], "rrf")


@query(lists_sql("select id, round(sum(s), 6) as score from (select id, 0.7 * score / (select max(score) from a) as s from a union all select id, 0.3 * score / (select max(score) from b) from b) x group by id order by 2 desc, 1 limit 10"))
def hybrid_weighted(t):
    return rt.fuse([*_lists(t)], [0.7, 0.3], "weighted")


@query(lists_sql("select id, round(sum(score), 6) as score from (select id, score from a union all select id, score from b) x group by id order by 2 desc, 1 limit 10"))
def hybrid_combsum(t):
    return rt.fuse([*_lists(t)], [1, 1], "combsum")


@query(lists_sql("select id, round(max(score), 6) as score from (select id, score from a union all select id, score from b) x group by id order by 2 desc, 1 limit 10"))
def hybrid_max(t):
    return rt.fuse([*_lists(t)], [1, 1], "max")


@query(lists_sql("select id, score, place from (select *, row_number() over (partition by id order by place) as rn from (select id, score, rank * 2 as place from a union all select id, score, rank * 2 + 1 from b) x) y where rn = 1"))
def dual_merge_interleave(t):
    return rt.interleave(*_lists(t)).select("id", "score", F.col("place").cast("long").alias("place"))


@query(lists_sql("select id, max(score) as score from (select id, 0.6 * score as score from a union all select id, 0.4 * score from b) x group by id"))
def dual_merge_weighted(t):
    a, b = _lists(t)
    both = a.select("id", (0.6 * F.col("score")).alias("score")).unionByName(b.select("id", (0.4 * F.col("score")).alias("score")))
    return rt.best_per_id(both, "id")


@query(lists_sql("select id, score from (select *, row_number() over (partition by id order by o) as rn from (select id, score, 0 as o from a union all select id, score, 1 from b) x) y where rn = 1"))
def dual_merge_concat(t):
    a, b = _lists(t)
    both = a.withColumn("o", F.lit(0)).unionByName(b.withColumn("o", F.lit(1)))
    return rt.best_per_id(both.withColumn("first", -F.col("o")), "id", "first").select("id", "score")


@query(lists_sql("select id, max(score) as score from (select id, score from a union all select id, score from b) x group by id order by 2 desc, 1 limit 10"))
def rank_and_dedup(t):
    a, b = _lists(t)
    return rt.best_per_id(a.unionByName(b), "id").orderBy(F.desc("score"), "id").limit(10)


# a frame of queries: the benchmark's texts ---------------------------------------------------------------
QUERIES = "q as (select item_id, text, string_split_regex(lower(text), '[ \\t\\n\\r\\f]+') as w from benchmark)"


@query(f"with {QUERIES} select item_id, array_to_string(list_slice(list_filter(w, x -> length(x) > 3), 1, 10), ' ') as keywords from q")
def dual_keywords_fallback(t):
    w = F.filter(tx.words(F.lower(F.col("text"))), lambda x: F.length(x) > 3)
    return t.benchmark.select("item_id", F.array_join(F.slice(w, 1, 10), " ").alias("keywords"))


@query(f"with {fx.ENTITIES} select entity_type, count(*) as n, round(avg(confidence), 6) as mean_confidence from entities group by 1")
def logic_count(t):
    return fx.entities(t).groupBy("entity_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("""with l as (select doc_id, quality, toxic from labels) select d.lang, count(*) as n, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents d join l on l.doc_id = d.doc_id group by 1""")
def benchmark_summary(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


# dual merges keep their ids; the summary tree groups chunks five by five