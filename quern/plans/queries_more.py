"""Similarity, linking, index, intent, boundary, metric and aggregation queries with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.similarity import jaro_winkler_pairs, resolve_overlaps
from quern.plans.queries_text import KEYWORDS, MENTIONS, WORDS, _mentions
from quern.plans.registry import query
from quern.runtime import stage

BLOCKS = "pairs as (select a.p_partkey as a, b.p_partkey as b, a.p_name as x, b.p_name as y from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey)"


#: How many pairs of parts a pair of names must stand for, on the whole, so that names are compared instead; names whose pairs are broadcast; pairs of a task; parts of a chunk at most.
REPEATED, NAMES, TASK, CHUNK = 64, 1000, 4_000_000, 8192


def _pairs(p, x: str, pairs: float, most: float):
    """(a, b, x, y) of parts of one brand and type, a < b, x and y being a column of them. Large blocks are cut by key into chunks of as many
    parts as make a task's pairs, CHUNK at most, and each pair of chunks meets by itself: a part is copied once for each chunk of its block, not for each task, and no pair is made twice."""
    tasks = max(1, min(4096, int(pairs // TASK)))
    chunk = max(1, min(CHUNK, int(max(TASK, pairs / 4096) ** 0.5)))
    cuts = int(-(-(most**0.5) // chunk))
    p = p.where("p_brand is not null and p_type is not null and p_partkey is not null").withColumnsRenamed({"p_brand": "brand", "p_type": "type"})
    at, chunks = F.lit(0), F.lit(1)
    if cuts > 1:  # one row for each block of more than a chunk
        ends = F.percentile_approx("p_partkey", [i / cuts for i in range(1, cuts)])
        large = p.groupBy(F.col("brand").alias("of_brand"), F.col("type").alias("of_type")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), ends.alias("ends")).where("chunks > 1")
        p = p.join(F.broadcast(stage(large, "blocks")), (F.col("brand") == F.col("of_brand")) & (F.col("type") == F.col("of_type")), "left")
        below = F.size(F.filter("ends", lambda e: e < F.col("p_partkey")))
        at, chunks = F.when(F.col("chunks").isNull(), 0).otherwise(F.floor(below * F.col("chunks") / cuts).cast("int")), F.coalesce("chunks", F.lit(1))
    p = p.withColumn("at", at).withColumn("last", chunks - 1)
    keys = ["brand", "type", "i", "j"]
    own = p.select("brand", "type", F.col("p_partkey").alias("a"), F.col(x).alias("x"), F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"))
    other = p.select("brand", "type", F.col("p_partkey").alias("b"), F.col(x).alias("y"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"))
    return own.repartition(tasks, *keys).join(other.repartition(tasks, *keys).hint("merge"), keys).where("a < b").select("a", "b", "x", "y")


def _scored(t, **scores):
    """(a, b, scores of their names x and y) of all pairs of parts of one brand and type. Where names repeat, each pair of names is scored once and looked up."""
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    pairs, most = p.groupBy("p_brand", "p_type").agg((F.count("*").cast("double") * F.count("*")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0.0))).collect()[0]
    own = p.select("p_name").distinct().limit(NAMES + 1)
    names = own.count()
    told = [s.alias(c) for c, s in scores.items()]
    if names > NAMES or pairs < REPEATED * names * names:
        return _pairs(p, "p_name", pairs, most).select("a", "b", *told)
    own = stage(own.withColumn("n", F.row_number().over(Window.orderBy("p_name")).cast("long")), "names")  # NAMES at most
    x, y = own.select(F.col("p_name").alias("x"), F.col("n").alias("nx")), own.select(F.col("p_name").alias("y"), F.col("n").alias("ny"))
    score = stage(x.crossJoin(y).select((F.col("nx") * 10_000 + F.col("ny")).alias("key"), *told), "name-pairs")
    marked = p.join(F.broadcast(own.withColumnRenamed("p_name", "name")), p["p_name"].eqNullSafe(F.col("name")))
    return _pairs(marked, "n", pairs, most).withColumn("key", F.col("x") * 10_000 + F.col("y")).join(F.broadcast(score), "key").select("a", "b", *scores)


_W = lambda c: WORDS.format(f"lower({c})")
_J = f"(case when len(list_distinct(list_concat({_W('x')}, {_W('y')}))) = 0 then 0 else len(list_intersect(list_distinct({_W('x')}), list_distinct({_W('y')}))) / cast(len(list_distinct(list_concat({_W('x')}, {_W('y')}))) as double) end)"


@query(f"with {BLOCKS} select a, b, round(case when x = '' and y = '' then 1 else {_J} end, 6) as jaccard from pairs")
def jaccard_tokens(t):
    return _scored(t, jaccard=F.round(tx.jaccard(tx.words(F.lower("x")), tx.words(F.lower("y")), 1.0), 6))


@query(f"with {BLOCKS} select a, b, round(case when levenshtein(x, y) > 2 then 0 else 1 - levenshtein(x, y) / cast(greatest(length(x), length(y)) as double) end, 6) as similarity from pairs")
def levenshtein_similarity(t):
    return _scored(t, similarity=F.round(tx.edit_similarity(F.col("x"), F.col("y"), 2), 6))


@query(f"with {BLOCKS} select a, b, round(case when lower(x) = lower(y) then 1 when contains(lower(x), lower(y)) or contains(lower(y), lower(x)) then 0.9 else {_J} end, 6) as similarity from pairs")
def string_similarity_contain(t):
    return _scored(t, similarity=F.round(tx.name_similarity(F.col("x"), F.col("y")), 6))


@query(f"with {BLOCKS} select a, b, round(case when lower(x) = lower(y) then 1 when contains(lower(x), lower(y)) or contains(lower(y), lower(x)) then 0.8 else {_J} end, 6) as similarity from pairs")
def name_similarity_logic(t):
    return _scored(t, similarity=F.round(tx.name_similarity(F.col("x"), F.col("y"), 0.8), 6))


@query(f"""with {BLOCKS}, s as (select *, {_J} as j, len(list_intersect(list_distinct({_W('x')}), list_distinct({_W('y')}))) / cast(least(len(list_distinct({_W('x')})), len(list_distinct({_W('y')}))) as double) as c from pairs)
 select a, b, round(0.4 * j + 0.4 * c + 0.2 * (1 - levenshtein(lower(x), lower(y)) / cast(greatest(length(x), length(y)) as double)), 6) as similarity from s""")
def fuzzy_text_similarity(t):
    return _scored(t, similarity=F.round(tx.fuzzy_similarity(F.col("x"), F.col("y")), 6))


@query()
def jaro_winkler(t):
    scorer = F.pandas_udf(jaro_winkler_pairs, "double")
    return _scored(t, similarity=F.round(scorer("x", "y"), 6))


def _code_sql(c: str) -> str:
    digits = lambda x: f"regexp_replace(translate({x}, '{tx.CODED}', '{tx.CODES}'), '[^1-6]', '', 'g')"
    u = f"regexp_replace(upper({c}), '[0-9]', '', 'g')"
    once = digits(u)
    for d in "123456":
        once = f"regexp_replace({once}, '{d}+', '{d}', 'g')"
    rest = f"case when {digits(f'substr({u}, 1, 1)')} <> '' then substr({once}, 2) else {once} end"
    return f"rpad(substr(case when regexp_matches({u}, '^\\p{{L}}') then substr({u}, 1, 1) else '' end || {rest}, 1, 4), 4, '0')"


@query(f"with {BLOCKS} select a, b, {_code_sql('x')} as code, case when {_code_sql('x')} = {_code_sql('y')} then cast(0.9 as double) else 0 end as similarity from pairs")
def soundex_phonetic(t):
    x, y = tx.phonetic_code(F.col("x")), tx.phonetic_code(F.col("y"))
    return _scored(t, code=x, similarity=F.when(x == y, 0.9).otherwise(0.0))


@query(f"with {MENTIONS}, top as (select name from mention group by 1 order by count(*) desc, name limit 1) select m.name, count(*) as shared from mention m where m.doc_id in (select doc_id from mention where name in (select name from top)) and m.name not in (select name from top) group by 1 order by 2 desc, 1 limit 50")
def co_occurring(t):
    m = _mentions(t).select("doc_id", "name")
    top = m.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(1).select("name")
    at = m.join(F.broadcast(top), "name").select("doc_id")
    return m.join(at, "doc_id", "left_semi").join(F.broadcast(top), "name", "left_anti").groupBy("name").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "name").limit(50)


@query(f"with {KEYWORDS}, d as (select term, count(distinct doc_id) as df from kw group by 1), m as (select max(df) as m from d) select cast(least(9, floor(10.0 * df / m)) as bigint) as bin, count(*) as n from d, m group by 1")
def concept_stats(t):
    d = t.documents.select("doc_id", F.explode(F.array_distinct(tx.keyword_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    top = d.agg(F.max("df").alias("m"))
    return d.join(F.broadcast(top)).groupBy(F.least(F.lit(9), F.floor(10.0 * F.col("df") / F.col("m"))).cast("long").alias("bin")).agg(F.count("*").alias("n"))




# Suffix rules of the tagger, in order.
TAGS = [("NUM", "^[0-9]+$"), ("ADV", "ly$"), ("VERB", "(ing|ed)$"), ("NOUN", "(tion|ment|ness|heit|ción)$"), ("ADJ", "(ble|ous|ful)$")]


@query(f"with w as (select doc_id, unnest({WORDS.format('lower(text)')}) as w from documents), t as (select doc_id, case " + " ".join(f"when regexp_matches(w, '{p}') then '{k}'" for k, p in TAGS) + " else 'X' end as tag from w) select doc_id, tag, count(*) as n from t group by 1, 2")
def tokenize_pos(t):
    tag = F.lit("X")
    for k, p in reversed(TAGS):
        tag = F.when(F.col("w").rlike(p), k).otherwise(tag)
    return t.documents.select("doc_id", F.explode(tx.words(F.lower("text"))).alias("w")).groupBy("doc_id", tag.alias("tag")).agg(F.count("*").alias("n"))


@query("select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+')) as emails, len(regexp_extract_all(text, 'https?://[^ \\t\\n\\r\\f]+')) as urls, len(regexp_extract_all(text, '[0-9]+')) as numbers from documents")
def custom_ner(t):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t.documents.select("doc_id", count("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+").alias("emails"), count(r"https?://[^ \t\n\r\f]+").alias("urls"), count("[0-9]+").alias("numbers"))


@query()
def ner_resolve_overlaps(t):
    """Non-overlapping spans of capitalised words and words with digits, the earlier, then surer, first."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(d, *s) for d, text in zip(b["doc_id"], b["text"]) for s in resolve_overlaps(text or "")], columns=["doc_id", "start", "end", "kind", "confidence"])

    return t.documents.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, end long, kind string, confidence double")

