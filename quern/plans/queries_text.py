"""Text, chunking, entity and source queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import chunks
from quern.operators import summaries
from quern.plans.registry import query
from quern.runtime import stage

WS = "[ \\t\\n\\r\\f]+"
WORDS = f"list_filter(string_split_regex({{}}, '{WS}'), x -> x <> '')"
KSTOP = "(" + ", ".join(f"'{w}'" for w in tx.KEYWORD_STOP_WORDS) + ")"
KEYWORDS = f"""kw as (select doc_id, term from (select doc_id, regexp_replace(unnest({WORDS.format('lower(text)')}), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') as term from documents) x where strlen(term) > 2 and term not in {KSTOP} and not regexp_full_match(term, '\\p{{N}}+'))"""
FREQUENT = f"""fw as (select doc_id, term from (select doc_id, unnest({WORDS.format('lower(text)')}) as term from documents) x where strlen(term) > 3 and term not in ({", ".join(f"'{w}'" for w in tx.FREQUENT)}))"""
SENTENCES = f"""parts as (select doc_id, string_split(regexp_replace(text, '([.!?]+){WS}', '\\1' || chr(1), 'g'), chr(1)) as p from documents),
 each as (select doc_id, trim(unnest(p)) as s, unnest(range(1, len(p) + 1)) as i from parts), sent as (select doc_id, s, row_number() over (partition by doc_id order by i) as at from each where length(s) > 5)"""


def _sentences(t):
    return t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("p", "s")).select("doc_id", "s", (F.col("p") + 1).cast("long").alias("at"))


@query(f"select doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) as clean_md5, len({WORDS.format('text')}) as n_words from documents")
def clean_text(t):
    return t.documents.select("doc_id", F.md5(tx.clean(F.col("text"))).alias("clean_md5"), tx.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"with {SENTENCES} select doc_id, at, md5(s) as sentence_md5 from sent")
def split_sentences(t):
    return _sentences(t).select("doc_id", "at", F.md5("s").alias("sentence_md5"))


@query(f"with {FREQUENT}, c as (select doc_id, term, count(*) as n from fw group by 1, 2) select doc_id, term, n from (select *, row_number() over (partition by doc_id order by n desc, term) as rn from c) x where rn <= 5")
def keywords_freq(t):
    c = t.documents.select("doc_id", F.explode(tx.frequent_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


#: Terms whose numbers of documents are broadcast are fewer than this.
COMMON = 16_384


@query(f"""with {KEYWORDS}, c as (select doc_id, term, count(*) as n from kw group by 1, 2), d as (select term, count(*) as df from c group by 1), l as (select doc_id, sum(n) as total from c group by 1),
 s as (select c.doc_id, c.term, round(c.n / cast(l.total as double) * greatest(0, ln((select count(*) from documents) / cast(d.df as double))), 6) as score from c join d using (term) join l using (doc_id))
 select doc_id, term, score from (select *, row_number() over (partition by doc_id order by score desc, term) as rn from s) x where rn <= 5""")
def keywords_tfidf(t):
    """Terms are counted in a document's row; only a term's share of its text meets the term's number of documents."""
    n = t.documents.count()
    own = t.documents.select("doc_id", tx.counted(tx.keyword_tokens(F.col("text"))).alias("terms")).where("terms is not null")
    one = own.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.count("*").alias("rows_of"))
    one = one.withColumn("total", F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a - x["n"]))
    words = F.transform("terms", lambda x: x["word"])
    summed = F.transform(F.array_distinct(words), lambda w: F.struct(F.aggregate(F.filter("terms", lambda x: x["word"] == w), F.lit(0), lambda a, x: a + x["n"]).alias("n"), w.alias("word")))
    one = stage(one.select("doc_id", "total", F.when(F.col("rows_of") == 1, F.col("terms")).otherwise(summed).alias("terms")), "terms")  # an id may stand in several rows
    c = one.select("doc_id", "total", F.explode("terms").alias("x")).select("doc_id", F.col("x.word").alias("term"), (F.lit(0) - F.col("x.n") / F.col("total")).alias("share"))
    d = stage(c.groupBy("term").agg(F.count("*").alias("df")), "document-counts")
    limit = (d.agg(F.sum("df")).collect()[0][0] or 0) // COMMON
    common = F.broadcast(d.where(F.col("df") > limit))  # fewer than COMMON terms whatever the input
    score = F.round(F.col("share") * F.greatest(F.lit(0.0), F.log(F.lit(float(n)) / F.col("df"))), 6).alias("score")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    best = lambda s: s.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")
    # a document's common terms lie together, so only its best five are shuffled; the others meet their counts by a shuffle
    met = c.join(common, "term").select("doc_id", "term", score)
    rest = c.join(common, "term", "left_anti").join(d.where(F.col("df") <= limit), "term").select("doc_id", "term", score)
    return best(best(met).unionByName(rest))


@query(f"with {KEYWORDS} select term, count(distinct doc_id) as df from kw group by 1")
def corpus_df(t):
    return t.documents.select("doc_id", F.explode(F.array_distinct(tx.keyword_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"select doc_id, len(string_split(text, chr(10))) as lines, len({WORDS.format('text')}) as n_words, length(text) as chars, strlen(text) as bytes, round(length(text) / cast(greatest(1, len({WORDS.format('text')})) as double), 6) as chars_per_word from documents")
def text_stats(t):
    n = tx.word_count(F.col("text"))
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), n.cast("long").alias("n_words"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.round(F.length("text") / F.greatest(F.lit(1), n), 6).alias("chars_per_word"))


JACCARD = "case when len(list_distinct(list_concat({a}, {b}))) = 0 then cast(0 as double) else len(list_intersect(list_distinct({a}), list_distinct({b}))) / cast(len(list_distinct(list_concat({a}, {b}))) as double) end"
SENTENCE_WORDS = SENTENCES + f", sw as (select doc_id, at, {WORDS.format('lower(s)')} as w from sent), prev as (select doc_id, at, w, lag(w) over (partition by doc_id order by at) as p from sw), j as (select doc_id, at, round({JACCARD.format(a='p', b='w')}, 6) as cohesion from prev where p is not null)"


def _cohesion(t):
    s = _sentences(t).withColumn("w", tx.words(F.lower("s")))
    s = s.withColumn("p", F.lag("w").over(Window.partitionBy("doc_id").orderBy("at")))
    return s.where("p is not null").select("doc_id", "at", F.round(tx.jaccard(F.col("p"), F.col("w")), 6).alias("cohesion"))


@query(f"with {SENTENCE_WORDS} select doc_id, at, cohesion from j")
def lexical_cohesion(t):
    return _cohesion(t)


@query("""with s as (select doc_id, text, unnest(range(0, greatest(0, length(text)), 450)) as o from documents) select doc_id, o // 450 as at, o as start_offset, md5(substring(text, o + 1, 500)) as content_md5 from s""")
def chunk_fixed(t):
    return chunks.fixed(t.documents).select("doc_id", "at", "start_offset", F.md5("content").alias("content_md5"))


@query("""with s as (select text, unnest(range(0, greatest(0, length(text)), 450)) as o from documents), c as (select length(substring(text, o + 1, 500)) as n from s) select count(*) as n_chunks, round(avg(n), 6) as mean_size, min(n) as least, max(n) as most from c""")
def chunking_stats(t):
    n = chunks.fixed(t.documents).select(F.length("content").cast("long").alias("n"))
    return n.agg(F.count("*").alias("n_chunks"), F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"))


@query()
def chunk_text(t):
    return chunks.chunk(t.documents, chunks.cut_text)


@query()
def chunk_hierarchical(t):
    return chunks.chunk(t.documents, chunks.cut_hierarchical)


@query()
def chunk_sentences(t):
    return chunks.chunk(t.documents, chunks.pack_sentences)


@query("select doc_id, case when regexp_matches(text, '[ñóéíáú]') then 'es' when regexp_matches(text, '[ãõç]') then 'pt' when regexp_matches(text, '[àèùâêîôû]') then 'fr' else 'en' end as language from documents")
def detect_language(t):
    return t.documents.select("doc_id", tx.language(F.col("text")).alias("language"))


@query("""with h as (select page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')) as m, unnest(range(len(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')))) as i from pages)
 select page_id, cast(i as bigint) as at, cast(regexp_extract(m, '<h([1-6])', 1) as integer) as level, trim(regexp_replace(m, '<[^>]*>', '', 'g')) as title from h""")
def parse_html_headings(t):
    m = F.regexp_extract_all("html", F.lit("(?s)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    h = t.pages.select("page_id", F.posexplode(m).alias("at", "m"))
    return h.select("page_id", F.col("at").cast("long").alias("at"), F.regexp_extract("m", "<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace("m", "<[^>]*>", "")).alias("title"))


HEADINGS = """h0 as (select page_id, unnest(regexp_extract_all(html, '<h([1-6])', 1)) as l, unnest(range(len(regexp_extract_all(html, '<h([1-6])', 1)))) as i from pages), h as (select page_id, cast(i as bigint) as at, cast(l as integer) as level from h0)"""


def _levels(t):
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])"), F.lit(1))).alias("at", "l")).select("page_id", F.col("at").cast("long").alias("at"), F.col("l").cast("int").alias("level"))


_stop = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
SCORES = f"""sp as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), x -> regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), x -> strlen(x) > 5) as e from documents),
 ss as materialized (select doc_id, len(e) as total, unnest(e) as s, unnest(range(1, len(e) + 1)) as at from sp), sv as (select *, {WORDS.format('s')} as w from ss),
 cw as (select doc_id, at, regexp_replace(lower(unnest(w)), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') as word from sv), ow as (select doc_id, at, count(*) over (partition by doc_id, word) as often from cw where word <> '' and word not in {_stop}), oa as (select doc_id, at, sum(often) / cast(count(*) as double) as often from ow group by 1, 2),
 score as (select doc_id, at, total, s, strlen(s) as bytes, round(0.3 * (case when at = 1 then 2.0 when at = total then 1.5 else 1 - 0.5 * (at - 1) / cast(total as double) end) + 0.2 * (case when len(w) < 5 then 0.3 when len(w) > 40 then 0.5 when len(w) between 10 and 25 then 1.0 else 0.7 end)
  + 0.3 * least(coalesce(often, 0) / 3, 1) + 0.1 * len(list_filter(w, x -> regexp_matches(x, '^\\p{{Lu}}') and strlen(x) > 2 and lower(x) not in {_stop})) / cast(greatest(len(w), 1) as double) + 0.1 * least(0.3 * len(list_filter(w, x -> regexp_matches(x, '\\p{{N}}'))), 1), 6) as score from sv left join oa using (doc_id, at))"""


@query(f"with {SCORES}, top as (select *, row_number() over (partition by doc_id order by score desc, at) as rn from score) select doc_id, md5(string_agg(s, ' ' order by at)) as summary_md5 from top where rn <= 3 group by 1")
def summarize_top_n(t):
    return summaries.best_sentences(t.documents, 3).select("doc_id", F.md5("summary").alias("summary_md5"))


@query(f"""with recursive {SCORES}, arr as materialized (select doc_id, list({{'at': at, 's': s, 'n': bytes}} order by score desc, at) as q from score group by 1),
 f(doc_id, i, held, taken) as (select doc_id, 0, cast(0 as bigint), cast([] as bigint[]) from arr union all select f.doc_id, i + 1, case when held + q[i + 1].n < 500 then held + q[i + 1].n + 1 else held end, case when held + q[i + 1].n < 500 then list_append(taken, q[i + 1].at) else taken end from f join arr on arr.doc_id = f.doc_id where i < len(q) and held < 450),
 last as (select doc_id, arg_max(taken, i) as taken from f group by 1), p as (select doc_id, q, case when len(taken) = 0 then [q[1].at] else taken end as taken from last join arr using (doc_id)), j as (select doc_id, array_to_string(list_transform(list_sort(list_filter(q, x -> list_contains(taken, x.at))), x -> x.s), ' ') as summary, q from p)
 select doc_id, md5(case when len(q) = 1 and q[1].n > 500 then regexp_replace(substring(q[1].s, 1, 497), '[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]*$', '') || '...' else summary end) as summary_md5 from j""")
def summarize_extractive(t):
    """The best sentences of each document within 500 bytes."""
    return summaries.summarize(t.documents).select("doc_id", F.md5("summary").alias("summary_md5"))


# entities of texts: capitalised words -----------------------------------------------------------------
MENTIONS = f"""m0 as (select doc_id, unnest({WORDS.format('text')}) as w from documents), m as (select doc_id, regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g') as name from m0), mention as (select doc_id, name, count(*) as n from m where length(name) > 4 and regexp_matches(name, '^[A-Z]') group by 1, 2)"""


def _mentions(t):
    w = F.transform(tx.words(F.col("text")), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    m = t.documents.select("doc_id", F.explode(w).alias("name")).where((F.length("name") > 4) & F.col("name").rlike("^[A-Z]"))
    return m.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("select c_custkey as id, lower(c_name) as normalised, c_nationkey as kind from customer")
def normalise_names(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("normalised"), F.col("c_nationkey").alias("kind"))


@query("select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def document_index_duplicates(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("select lang, source, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1, 2")
def document_index_by_type(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is not null")
def import_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
