"""Fusion and ranking of results, answers, summary trees, vector stores and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vector as vx
from quern.functions.similarity import bleu, rouge_l
from quern.operators import chunks, metrics, tree
from quern.operators import retrieval as rt
from quern.plans.queries_retrieval import COS, HYBRID, LISTS, _lists, lists_sql, query_vector
from quern.plans.registry import query
from quern.sources import fixtures as fx

WS = "[ \\t\\n\\r\\f]+"
W = f"list_filter(string_split_regex({{}}, '{WS}'), x -> x <> '')"
_list = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"

KINDS = ["Chunk", "Entity", "GraphPath", "HierarchicalSummary", "Hybrid"]
RESULTS = f"res as (select cast(conv_id * 100 + turn as varchar) as id, text as content, {_list(KINDS)}[1 + (conv_id + turn) % 5] as kind, ((conv_id * 7 + turn * 3) % 100) / cast(100 as double) as score from conversations)"


def _results(t):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("id"), F.col("text").alias("content"), kind.alias("kind"), (((F.col("conv_id") * 7 + F.col("turn") * 3) % 100) / F.lit(100.0)).alias("score"))


@query(lists_sql("select id, score, case when starts_with(id, 'entity:') then 'Entity' when starts_with(id, 'chunk:') then 'Chunk' else 'Hybrid' end as kind from (select id, round(sum(score), 6) as score from (select 'chunk:' || cast(id as varchar) as id, score from a union all select 'entity:' || cast(id as varchar), score from b) x group by 1) y where score >= 0.1 order by score desc, id limit 10"))
def hybrid_finalise(t):
    a, b = _lists(t)
    name = lambda df, p: df.select(F.concat(F.lit(p), F.col("id").cast("string")).alias("id"), "score")
    return rt.finalise(rt.fuse([name(a, "chunk:"), name(b, "entity:")], [1, 1], "combsum", k=None))


@query(lists_sql("select coalesce(a.id, b.id) as id, cast(round(cast(0.3 as decimal(4, 2)) * cast(coalesce(a.score, 0) as decimal(18, 6)) + cast(0.4 as decimal(4, 2)) * cast(coalesce(b.score, 0) as decimal(18, 6)), 6) as double) as score from a full join b on a.id = b.id"))
def multimodal_score(t):
    return rt.multimodal(*_lists(t))


@query(f"with {RESULTS} select substring(content, 1, 50) as signature, count(distinct kind) as kinds, round(least(cast(1 as double), avg(score) + 0.2 * (count(distinct kind) - 1)), 6) as score from res group by 1 having count(distinct kind) > 1")
def cross_strategy_fusion(t):
    return rt.cross_strategy(_results(t))


RANKED = f"""{RESULTS}, bo as (select id, kind, content, round(score * case kind when 'Entity' then 1.2 when 'GraphPath' then 1.1 when 'Hybrid' then 1.15 else 1 end * power(cast(1.1 as double), len(list_filter(['the', 'que'], x -> contains(lower(content), x)))), 6) as score from res),
 un as (select * from (select *, row_number() over (partition by substring(content, 1, 50), length(content) order by score desc, id) as rn from bo) x where rn = 1), pl as (select id, kind, score, row_number() over (partition by kind order by score desc, id) as place from un)"""


@query(f"with {RANKED} select * from pl where place <= case kind when 'Entity' then 10 when 'Chunk' then 15 when 'GraphPath' then 7 when 'HierarchicalSummary' then 7 else 6 end")
def adaptive_rank_dedup(t):
    return rt.adaptive_rank(_results(t), ["The", "que", "the"])


CONTEXT = f"{RESULTS}, cx as (select case when score >= 0.7 and kind in ('Chunk', 'Entity') then 'primary' when score >= 0.3 then 'supporting' end as part, id, score from res where kind <> 'HierarchicalSummary' union all select 'summary', id, score from res where kind = 'HierarchicalSummary'), cp as (select *, row_number() over (partition by part order by score desc, id) as place from cx where part is not null), ct as (select * from cp where place <= case part when 'summary' then 3 else 5 end)"


def _context(t):
    r = _results(t)
    return rt.context(r.where("kind <> 'HierarchicalSummary'"), r.where("kind = 'HierarchicalSummary'"))


@query(f"with {CONTEXT} select part, id, score, place from ct")
def assemble_context(t):
    return _context(t)


@query(f"with {CONTEXT} select round(least(cast(1 as double), 0.5 * coalesce(avg(score) filter (part = 'primary'), 0) + 0.3 * coalesce(avg(score) filter (part = 'supporting'), 0) + 0.2 * coalesce(avg(score) filter (part = 'summary'), 0)), 6) as confidence, count(*) as sources from ct")
def context_confidence(t):
    return rt.context_confidence(_context(t))


@query(f"with {RESULTS} select id, round(least(cast(1 as double), score * case when strlen(content) < 20 then 0.7 else 1 end * case when contains(content, 'No relevant') or contains(content, 'insufficient') then 0.5 else 1 end + least(cast(0.2 as double), 0.1 * len(list_filter(['la', 'the', 'sur'], x -> contains(lower(content), x))))), 6) as confidence from res")
def answer_confidence(t):
    return _results(t).select("id", rt.answer_confidence(F.col("score"), F.col("content"), ["La", "the", "sur"]).alias("confidence"))


@query(f"with {RESULTS}, r as (select kind, content, score, id, row_number() over (partition by kind order by score desc, id) as rn from res) select kind, md5(string_agg(content, chr(10) || chr(10) order by rn)) as answer_md5, string_agg(id || ' (' || cast(cast(score * 100 as integer) as varchar) || ')', ', ' order by rn) as sources from r where rn <= 3 group by 1")
def answer_fallback(t):
    """The three best contents of each type, and a list of them with their scores in hundredths."""
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    top = _results(t).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    g = top.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("rn", "content", "id", "score"))).alias("x"))
    said = F.transform("x", lambda r: F.concat(r["id"], F.lit(" ("), F.round(r["score"] * 100).cast("int").cast("string"), F.lit(")")))
    return g.select("kind", F.md5(F.array_join(F.transform("x", lambda r: r["content"]), "\n\n")).alias("answer_md5"), F.array_join(said, ", ").alias("sources"))


@query(lists_sql("select id, max(score) as score from (select id, score from a union all select id, score from b union all select id, round(score * 0.9, 6) from b where rank < 20) x group by id order by 2 desc, 1 limit 10"))
def multi_query_merge(t):
    """The lists of several sub-queries: the best score of each id, the first ten."""
    a, b = _lists(t)
    third = b.orderBy(F.desc("score"), "id").limit(20).select("id", F.round(F.col("score") * 0.9, 6).alias("score"))
    return a.unionByName(b).unionByName(third).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"with {LISTS}, top as (select *, row_number() over (order by score desc, id) as rn from a order by score desc, id limit 5) select rn as step, id, round(score / (select max(score) from a), 6) as relevance, md5(substring(text, 1, 200)) as excerpt_md5, (select round(0.7 * avg(score) / (select max(score) from a) + 0.3, 6) from top) as confidence from top join documents on doc_id = id")
def explained_answer(t):
    """Five sources with an excerpt of 200 characters each, in steps, and .7 of their mean relevance + .3."""
    best = rt.bm25_search(t.documents, HYBRID, k=5)
    w = Window.partitionBy(F.lit(1))  # five rows
    top = best.withColumn("step", F.row_number().over(w.orderBy(F.desc("score"), "doc_id")).cast("long")).withColumn("m", F.max("score").over(w)).withColumn("v", F.avg("score").over(w))
    return t.documents.select("doc_id", "text").join(F.broadcast(top), "doc_id").select("step", F.col("doc_id").alias("id"), F.round(F.col("score") / F.col("m"), 6).alias("relevance"), F.md5(F.substring("text", 1, 200)).alias("excerpt_md5"), F.round(0.7 * F.col("v") / F.col("m") + 0.3, 6).alias("confidence"))


# vectors ---------------------------------------------------------------------------------------------------------
@query()
def vector_ann(t):
    """Approximate neighbours of every twentieth vector; tests measure the recall against batch_search."""
    return rt.vector_ann(t.embeddings, t.embeddings.where("vec_id % 20 = 0"))


@query(f"select a.vec_id as a, b.vec_id as b, round({COS}, 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where round({COS}, 6) > 0.1")
def pairwise_similarities(t):
    """All pairs of vectors with a cosine over .1, whatever their labels."""
    return rt.group_pairs(t.embeddings, None, "vec_id", "embedding", 0.1, part=2048)


@query("select vec_id, len(embedding) as dims, vec_id >= 1000000 as added from (select vec_id, embedding from embeddings where vec_id % 9 <> 0 union all select vec_id + 1000000, embedding from embeddings where vec_id % 10 = 0) x")
def vector_store(t):
    """A store after a batch was added, with new ids, and every ninth was removed."""
    from quern.sources.stores import VectorStore

    e = t.embeddings.select("vec_id", "embedding")
    store = VectorStore(t.spark, "vec_id").add(e).add(e.where("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)).remove(e.where("vec_id % 9 = 0").select("vec_id"))
    return store.rows().select("vec_id", F.size("embedding").cast("long").alias("dims"), (F.col("vec_id") >= 1000000).alias("added"))


@query(f"select * from (select a.vec_id, round({COS}, 6) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b order by 2 desc, 1 limit 10) x where score >= 0.2")
def search_with_threshold(t):
    return rt.vector_search(t.embeddings, query_vector(t), k=10).where("score >= 0.2")


@query("select a.vec_id as id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), x -> power(cast(a.embedding[x] as double) - cast(b.embedding[x] as double), 2)))), 5) as distance, round(exp(-sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), x -> power(cast(a.embedding[x] as double) - cast(b.embedding[x] as double), 2))))), 6) as score from embeddings a, (select embedding from embeddings where vec_id = 7) b order by 2, 1 limit 10")
def vector_search_euclidean(t):
    """The score of the indexed search: exp(-distance)."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(t)])
    d = vx.euclidean(F.col("embedding"), q)
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(d, 5).alias("distance"), F.round(F.exp(-d), 6).alias("score")).orderBy("distance", "id").limit(10)


@query(f"with w as (select item_id, unnest({W.format('lower(text)')}) as w from benchmark), v as (select item_id, w, i, (cast('0x' || substr(md5(w || '#' || cast(i as varchar)), 1, 8) as bigint) % 2000) / cast(1000 as double) - 1 as x from w, (select unnest(range(16)) as i) z), n as (select item_id, w, i, x, sqrt(sum(x * x) over (partition by item_id, w)) as z from (select distinct * from v) q), k as (select item_id, w, count(*) as times from w group by 1, 2), m as (select n.item_id, n.i, sum(times * n.x / n.z) / sum(times) as x from n join k on k.item_id = n.item_id and k.w = n.w group by 1, 2) select item_id, cast(i as bigint) as dim, round(x / sqrt(sum(x * x) over (partition by item_id)), 5) as value from m")
def hash_embedding(t):
    """Text vectors: unit vectors of the words' digests, their mean, made unit again."""
    return vx.text_embeddings(t.benchmark, "item_id", "text", 16).select("item_id", "dim", F.round("value", 5).alias("value"))


# trees -----------------------------------------------------------------------------------------------------------
LEAVES = f"""chunk as (select doc_id, o // 450 as at, o as start, substring(text, o + 1, 500) as content from (select doc_id, text, unnest(range(0, greatest(0, length(text)), 450)) as o from documents) z),
 kw as (select doc_id, at, word, count(*) as n from (select doc_id, at, unnest({W.format('lower(content)')}) as word from chunk) x where strlen(word) > 3 and word not in ({_list(tx.FREQUENT)[1:-1]}) group by 1, 2, 3), kt as (select doc_id, at, list(word order by word) as keywords from (select *, row_number() over (partition by doc_id, at order by n desc, word) as rn from kw) x where rn <= 5 group by 1, 2),
 n0 as (select c.doc_id, 0 as level, c.at, cast(0 as bigint) as children, content, coalesce(keywords, []) as keywords, start, start + length(content) as "end" from chunk c left join kt on kt.doc_id = c.doc_id and kt.at = c.at)"""


def _levels_sql(most: int) -> str:
    out = LEAVES
    for k in range(1, most + 1):
        out += f""", n{k} as (select doc_id, {k} as level, at // 5 as at, count(*) as children, string_agg(content, chr(10) || chr(10) order by at) as content, list_slice(list_sort(list_distinct(flatten(list(keywords)))), 1, 10) as keywords, min(start) as start, max("end") as "end" from (select *, max(at) over (partition by doc_id) as last from n{k - 1}) x where last > 0 group by doc_id, at // 5)"""
    return out + ", nodes as (" + " union all ".join(f"select * from n{k}" for k in range(most + 1)) + ")"


TREE = _levels_sql(6)


def _tree(t):
    return tree.build(chunks.fixed(t.documents))


@query(f"""with {TREE} select doc_id, level, at, children, md5(content) as content_md5, array_to_string(keywords, ',') as keywords, start, "end" from nodes""")
def tree_merge_level(t):
    return _tree(t).select("doc_id", "level", "at", "children", F.md5("content").alias("content_md5"), F.array_join("keywords", ",").alias("keywords"), "start", "end")


ASKED = ["onen", "eraux", "with", "thea"]


@query(f"""with {TREE}, h as (select doc_id, level, at, len(list_intersect(keywords, {_list(ASKED)})) as hits, len(list_intersect(list_distinct({W.format('lower(content)')}), {_list(ASKED)})) as found from nodes)
 select doc_id, level, at, round(hits + 2 * found / cast(4 as double) + case when hits + found > 0 then 0.5 / (level + 1) else 0 end, 6) as score from h where round(hits + 2 * found / cast(4 as double) + case when hits + found > 0 then 0.5 / (level + 1) else 0 end, 6) > 0.1 order by 4 desc, 1, 2, 3 limit 10""")
def tree_query(t):
    return tree.search(_tree(t), ASKED)


@query(f"with {TREE} select l.doc_id, l.at, u.level, u.at as ancestor from n0 l join nodes u on u.doc_id = l.doc_id and u.level > 0 and u.at = l.at // cast(power(5, u.level) as bigint)")
def tree_ancestors(t):
    return tree.ancestors(tree.shape(chunks.fixed(t.documents)))


@query(f"with {TREE} select level, count(*) as nodes, cast(sum(children) as bigint) as children, round(avg(length(content)), 6) as mean_size, count(*) filter (level = last) as roots from (select *, max(level) over (partition by doc_id) as last from nodes) x group by 1")
def tree_stats(t):
    n = _tree(t).select("doc_id", "level", "children", F.length("content").alias("n_chars")).withColumn("last", F.max("level").over(Window.partitionBy("doc_id")))
    return n.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("children").alias("children"), F.round(F.avg("n_chars"), 6).alias("mean_size"), F.sum((F.col("level") == F.col("last")).cast("long")).alias("roots"))


# metrics ---------------------------------------------------------------------------------------------------------
REFERENCES = "bm as (select row_number() over (order by item_id, text) - 1 as place, text as r from benchmark), pr as (select d.doc_id, d.text as c, bm.r from documents d join bm on bm.place = d.doc_id % (select count(*) from benchmark))"


@query(f"with {REFERENCES}, w as (select doc_id, {W.format('lower(c)')} as a, {W.format('lower(r)')} as b, lower(trim(c)) = lower(trim(r)) as em from pr), h as (select *, len(list_filter(a, x -> list_contains(b, x))) as hit from w) select doc_id, em, round(case when hit = 0 then 0 else 2 * (hit / cast(len(a) as double)) * (hit / cast(len(b) as double)) / (hit / cast(len(a) as double) + hit / cast(len(b) as double)) end, 6) as f1 from h")
def metric_em_f1(t):
    """Every document against a benchmark text, dealt out by the benchmark's own number of rows."""
    return metrics.exact_and_f1(metrics.paired(t.documents, t.benchmark))


@query()
def metric_bleu(t):
    p = metrics.paired(t.benchmark.select(F.col("item_id").alias("doc_id"), "text"), t.conversations.select(F.col("conv_id").alias("item_id"), "text"))
    scorer = F.pandas_udf(bleu, "double")
    return p.select("doc_id", F.round(scorer("text", "reference"), 6).alias("bleu"))


@query()
def metric_rouge_l(t):
    p = metrics.paired(t.conversations.select(F.col("conv_id").alias("doc_id"), "text"), t.benchmark)
    scorer = F.pandas_udf(rouge_l, "double")
    return p.select("doc_id", F.round(scorer("text", "reference"), 6).alias("rouge_l"))


@query(f"with {REFERENCES}, w as (select doc_id, list_distinct({W.format('lower(c)')}) as a, list_distinct({W.format('lower(r)')}) as b from pr) select doc_id, round(len(list_intersect(a, b)) / cast(len(b) as double), 6) as recall from w")
def metric_recall(t):
    return metrics.recall(metrics.paired(t.documents, t.benchmark))


@query("""with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
 select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, round(min(value), 6) as least, round(max(value), 6) as most, round(max(value) filter (i = cast(floor(n * 0.5) as bigint)), 6) as p50, round(max(value) filter (i = cast(floor(n * 0.95) as bigint)), 6) as p95, round(max(value) filter (i = cast(floor(n * 0.99) as bigint)), 6) as p99 from v group by 1""")
def histogram_stats(t):
    """Quantiles by index floor(n p), from counts of values by range, so that a type's rows aren't sorted in one task."""
    return metrics.histogram(t.events.where("value is not null"), "event_type", "value")


@query("""select 'documents' as what, 'not blank' as check, count(*) as rows, count(*) filter (text is null or trim(text) = '') as failed from documents union all select 'documents', 'at least 50 characters', count(*), count(*) filter (length(text) < 50) from documents
 union all select 'documents', 'unique id', count(*), count(*) - count(distinct doc_id) from documents union all select 'documents', 'known language', count(*), count(*) filter (lang is null) from documents""".replace("as check", 'as "check"'))
def validate_documents(t):
    d = t.documents
    return metrics.checks(d, "documents", {"not blank": d["text"].isNull() | (F.trim("text") == ""), "at least 50 characters": F.length("text") < 50, "known language": d["lang"].isNull()}, "doc_id")


G = f"{fx.ENTITIES}, {fx.RELATIONSHIPS}"


@query(f"""with {G} select 'entities' as what, 'named' as "check", count(*) as rows, count(*) filter (name is null or trim(name) = '') as failed from entities union all select 'entities', 'sure enough', count(*), count(*) filter (confidence < 0.55) from entities union all select 'entities', 'unique id', count(*), count(*) - count(distinct id) from entities
 union all select 'relationships', 'not a loop', count(*), count(*) filter (source = target) from relationships union all select 'relationships', 'sure enough', count(*), count(*) filter (confidence < 0.55) from relationships
 union all select 'relationships', 'both ends known', count(*), count(*) filter (source not in (select id from entities) or target not in (select id from entities)) from relationships""")
def validate_graph(t):
    e, r = fx.entities(t), fx.relationships(t)
    whole = r.join(e.select(F.col("id").alias("source")), "source", "left_semi").join(e.select(F.col("id").alias("target")), "target", "left_semi").agg(F.count("*").alias("good"))
    ends = r.agg(F.count("*").alias("rows")).join(whole).select(F.lit("relationships").alias("what"), F.lit("both ends known").alias("check"), "rows", (F.col("rows") - F.col("good")).alias("failed"))
    one = metrics.checks(e, "entities", {"named": F.col("name").isNull() | (F.trim("name") == ""), "sure enough": F.col("confidence") < 0.55}, "id")
    return one.union(metrics.checks(r, "relationships", {"not a loop": F.col("source") == F.col("target"), "sure enough": F.col("confidence") < 0.55})).union(ends)


@query("""with s as (select user_id, event_id, value, lag(value, 3) over (partition by user_id order by event_id) as before, row_number() over (partition by user_id order by event_id desc) as rn from events where value is not null), l as (select user_id, (value - before) / 3 as slope from s where rn = 1 and before is not null),
 b as (select user_id, slope, case when slope < 0.01 then cast(1.05 as double) else 1 end as w from l) select user_id, round(slope, 6) as slope, round(w / (select sum(w) from b), 9) as weight from b""")
def weight_optimizer(t):
    """Each user's values as an objective: slopes over the last four steps; those under .01 are boosted, weights normalised."""
    return metrics.reweight(t.events.where("value is not null"), "user_id", "event_id", "value")
