"""Layout, boundary, section, enrichment and language queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vector as vx
from quern.operators import chunks, layout
from quern.plans.queries_text import SENTENCE_WORDS, SENTENCES, WORDS, WS, _cohesion, _sentences
from quern.plans.registry import query

MD = "md as (select page_id, " + "regexp_replace(" * 8 + "html" + "".join(f", '<h{k}[^>]*>', chr(10) || '{'#' * k} ', 'g')" for k in range(1, 7)) + ", '</h[1-6]>', chr(10), 'g'), '<[^>]*>', '', 'g') as text from pages)"


def _md(t):
    """The pages as Markdown: headings as lines with #, other tags gone."""
    c = F.col("html")
    for k in range(1, 7):
        c = F.regexp_replace(c, f"<h{k}[^>]*>", "\n" + "#" * k + " ")
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace(c, "</h[1-6]>", "\n"), "<[^>]*>", "").alias("text"))


LINES = f"{MD}, l0 as (select page_id, string_split(text, chr(10)) as l from md), l1 as (select page_id, unnest(l) as line, unnest(range(len(l))) as i from l0), ln as (select page_id, i, line, cast(sum(length(line) + 1) over (partition by page_id order by i) - length(line) - 1 as bigint) as start from l1)"
HEADS = f"""{LINES}, hd as (select page_id, row_number() over (partition by page_id order by start) - 1 as at, length(regexp_extract(line, '^(#+)', 1)) as level, trim(regexp_replace(line, '^#+', '')) as title, start, start + length(line) as "end" from ln where regexp_matches(line, '^#{{1,6}} +[^ ]'))"""


@query(f'with {HEADS} select page_id, at, cast(level as integer) as level, title, start, "end" from hd')
def parse_markdown(t):
    return layout.markdown(_md(t), "page_id")


SECTIONS = f"""{HEADS}, sec as (select h.page_id, h.at, cast(level as integer) as level, h."end" as start, coalesce(lead(h.start) over (partition by h.page_id order by at), length(text)) as finish from hd h join md on md.page_id = h.page_id)"""


@query(f"with {SECTIONS} select * from sec")
def build_sections(t):
    return layout.sections(layout.markdown(_md(t), "page_id"), _md(t), "page_id")


PATHS = f"""{HEADS}, tree(page_id, at, level, parent_at, depth, path) as (select h.page_id, h.at, h.level, cast(null as bigint), cast(1 as bigint), h.title from hd h where not exists (select 1 from hd b where b.page_id = h.page_id and b.at < h.at and b.level < h.level)
 union all select h.page_id, h.at, h.level, p.at, p.depth + 1, p.path || ' > ' || h.title from tree p join hd h on h.page_id = p.page_id and p.at = (select max(b.at) from hd b where b.page_id = h.page_id and b.at < h.at and b.level < h.level))"""


@query(f"with recursive {PATHS} select page_id, at, cast(level as integer) as level, parent_at, depth from tree")
def build_hierarchy(t):
    return layout.hierarchy(layout.markdown(_md(t), "page_id"), "page_id").drop("path")


@query(f"with recursive {PATHS} select page_id, at, path from tree")
def heading_path(t):
    return layout.hierarchy(layout.markdown(_md(t), "page_id"), "page_id").select("page_id", "at", "path")


@query(f'with {SECTIONS}, p as (select page_id, unnest(range(0, greatest(1, length(text)), 300)) as "offset" from md) select p.page_id, p."offset", sec.at as section from p left join sec on sec.page_id = p.page_id and sec.start <= p."offset" and p."offset" < sec.finish')
def section_for_offset(t):
    """The section that every three hundredth character lies in."""
    md = _md(t)
    places = md.select("page_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(300)).cast("array<long>")).alias("offset"))
    return layout.section_of(places, layout.sections(layout.markdown(md, "page_id"), md, "page_id"), "page_id")


LEVEL = """case when regexp_matches(trim(line), '^#{1,6} ') then length(regexp_extract(trim(line), '^(#+)', 1)) when length(trim(line)) >= 5 and length(regexp_replace(trim(line), '[^\\p{L}]', '', 'g')) > 0 and upper(trim(line)) = trim(line) and lower(trim(line)) <> trim(line) then case when length(trim(line)) < 20 then 1 when length(trim(line)) < 40 then 2 else 3 end
 when regexp_matches(trim(line), '^[0-9]+(\\.[0-9]+)*\\.?[ \\t]') then len(string_split(regexp_extract(trim(line), '^([0-9]+(\\.[0-9]+)*)\\.?[ \\t]', 1), '.')) end"""


@query(f"""with {LINES}, nb as (select *, lead(line) over (partition by page_id order by i) as below from ln), lv as (select page_id, start, trim(line) as title, case when regexp_matches(below, '^={{3,}}$') then 1 when regexp_matches(below, '^-{{3,}}$') then 2 when regexp_matches(line, '^(={{3,}}|-{{3,}})$') then null else {LEVEL} end as level from nb where trim(line) <> '')
 select page_id, cast(level as integer) as level, title, start from lv where level is not null""")
def parse_plaintext(t):
    return layout.plaintext(_md(t), "page_id")


@query(f"""with {LINES}, lv as (select page_id, i, trim(line) as title, {LEVEL} as level from ln where trim(line) <> '') select page_id, arg_min(title, i) as title, cast(arg_min(level, i) as integer) as level from lv where level is not null group by 1""")
def extract_title(t):
    """The first line that reads like a heading."""
    ln = layout.lines(_md(t), "page_id").where("trim(line) <> ''").select("page_id", "i", F.trim("line").alias("title"), tx.heading_level(F.col("line")).cast("int").alias("level")).where("level is not null")
    return ln.groupBy("page_id").agg(F.min(F.struct("i", "title", "level")).alias("x")).select("page_id", "x.title", "x.level")


NUMBERED = """nt as (select o_orderkey as id, case o_orderkey % 8 when 0 then cast(o_orderkey % 9 as varchar) || '.' || cast(o_orderkey % 7 as varchar) || ' Title' when 1 then 'Chapter ' || cast(o_orderkey % 30 as varchar) when 2 then 'appendix B' when 3 then ['IV', 'XIX', 'MCMXC', 'III'][1 + o_orderkey % 4] || '. Title' when 4 then 'A) Title' when 5 then 'Section 3.2 of it' when 6 then '12) Title' else 'No number' end as title from orders)"""
_ROMAN = "list_sum(list_transform(range(1, length(r) + 1), i -> case when i < length(r) and v[substr(r, i, 1)] < v[substr(r, i + 1, 1)] then -v[substr(r, i, 1)] else v[substr(r, i, 1)] end))"


@query(f"""with {NUMBERED}, x as (select id, title, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)[.)]?(?: |$)', 1) as d, regexp_extract(title, '(?i)^(?:chapter|section|part|appendix) +([0-9]+(?:\\.[0-9]+)*|[A-Z])\\b', 1) as w, regexp_extract(title, '^([IVXLCDM]+)[.)] ', 1) as r, regexp_extract(title, '^([A-Z])[.)] ', 1) as a, map {{'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}} as v from nt)
 select id, case when d <> '' then d when w <> '' then upper(w) when r <> '' then cast(cast({_ROMAN.replace('i -> ', 'lambda i: ')} as bigint) as varchar) when a <> '' then a end as number from x""")
def section_number(t):
    """Numbers of headings, of the kinds that there are."""
    k = F.col("o_orderkey")
    roman = F.get(F.array(*[F.lit(x) for x in ("IV", "XIX", "MCMXC", "III")]), (k % 4).cast("int"))
    title = F.when(k % 8 == 0, F.concat((k % 9).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(" Title"))).when(k % 8 == 1, F.concat(F.lit("Chapter "), (k % 30).cast("string"))).when(k % 8 == 2, "appendix B").when(k % 8 == 3, F.concat(roman, F.lit(". Title"))).when(k % 8 == 4, "A) Title").when(k % 8 == 5, "Section 3.2 of it").when(k % 8 == 6, "12) Title").otherwise("No number")
    return t.orders.select(k.alias("id"), layout.section_number(title).alias("number"))


# boundaries -------------------------------------------------------------------------------------------------------
TEXTS = f"{MD}, tb as (select doc_id as id, text from documents union all select page_id + 100000000, text from md)"


def _texts(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text").union(_md(t).select(F.col("page_id") + 100000000, "text"))


_caps = "length(regexp_replace(line, '[^\\p{L}]', '', 'g')) >= 5 and upper(line) = line and length(trim(line)) < 80"
_item = lambda c: f"coalesce(regexp_matches({c}, '^[ \\t]*([-*+]|[0-9]+[.)])[ \\t]'), false)"
_ind = lambda c: f"coalesce(regexp_matches({c}, '^(    |\\t)[^ \\t]'), false)"


def _starts(pattern: str) -> str:
    return f"select id, cast(sum(n) over (partition by id order by i rows between unbounded preceding and 1 preceding) as bigint) as position, i from (select id, unnest(list_transform(p, x -> length(x))) as n, unnest(range(len(p))) as i from (select id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1', 'g'), chr(1)) as p from tb) z) y"


BOUNDARIES = f"""{TEXTS}, bl0 as (select id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from tb), bl as (select *, cast(sum(length(line) + 1) over (partition by id order by i) - length(line) - 1 as bigint) as start, lead(line) over (partition by id order by i) as below, lag(line) over (partition by id order by i) as above from bl0),
 bo as (select id, position, 'paragraph' as kind, cast(1 as double) as confidence from ({_starts('\\n[ \\t\\r\\f]*\\n')}) x where i > 0
 union all select id, start, 'heading', case when regexp_matches(line, '^#{{1,6}} ') then cast(0.95 as double) when trim(line) <> '' and regexp_matches(below, '^(={{3,}}|-{{3,}}|~{{3,}})$') then 0.9 when regexp_matches(line, '^(?:Chapter|Section|Part|Appendix|Introduction|Conclusion|Abstract|Summary)\\b') then 0.85 when {_caps} then 0.7 end from bl
 union all select id, start, 'list', cast(0.9 as double) from bl where {_item('line')} and not {_item('above')} union all select id, start, 'list', cast(0.9 as double) from bl where {_item('line')} and not {_item('below')} and {_item('above')}
 union all select id, start, 'code', cast(1 as double) from bl where starts_with(line, '```') union all select id, start, 'code', cast(0.7 as double) from bl where {_ind('line')} and not {_ind('above')}
 union all select id, position, 'sentence', cast(0.9 as double) from ({_starts('[.!?]+[ \\t\\n\\r\\f]+')}) x where i > 0 and position >= 10), bn as (select * from bo where confidence is not null)"""


@query(f"with {BOUNDARIES} select id, kind, count(*) as n, min(position) as first, max(position) as last, round(avg(confidence), 6) as mean_confidence from bn group by 1, 2")
def boundary_kinds(t):
    """Boundaries of each of the five kinds: paragraph, heading, list, code, sentence."""
    return layout.boundaries(_texts(t), "id").groupBy("id", "kind").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"with {BOUNDARIES} select id, position, arg_min(kind, {{'o': -confidence, 'k': kind}}) as kind, max(confidence) as confidence from bn group by 1, 2")
def detect_boundaries(t):
    return layout.merged(layout.boundaries(_texts(t), "id"), "id")


# sentences and coherence ------------------------------------------------------------------------------------------
@query(f"with {SENTENCE_WORDS}, c as (select doc_id, avg(cohesion) as c, count(*) as pairs from j group by 1) select d.doc_id, round(coalesce(c.c, 1), 5) as coherence, coalesce(pairs, 0) as pairs from documents d left join c on c.doc_id = d.doc_id")
def coherence_adjacent(t):
    """Mean likeness of neighbouring sentences; 1 for texts of fewer than two."""
    c = _cohesion(t).groupBy("doc_id").agg(F.avg("cohesion").alias("c"), F.count("*").alias("pairs"))
    return t.documents.select("doc_id").join(c, "doc_id", "left").select("doc_id", F.round(F.coalesce("c", F.lit(1.0)), 5).alias("coherence"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query(f"""with {SENTENCES}, w as (select doc_id, at, s, {WORDS.format('lower(s)')} as w from sent), p as (select *, lag(w) over (partition by doc_id order by at) as q from w),
 n as (select doc_id, at, s, case when q is null or len(list_intersect(list_distinct(q), list_distinct(w))) < 0.7 * len(list_distinct(list_concat(q, w))) then 1 else 0 end as new from p), r as (select *, sum(new) over (partition by doc_id order by at) as topic from n), g as (select doc_id, cast(topic as bigint) as topic, count(*) as sentences, string_agg(s, ' ' order by at) as content from r group by 1, 2) select doc_id, topic, sentences, md5(content) as content_md5 from g where length(content) >= 100""")
def chunk_topic(t):
    return layout.topics(_sentences(t), "doc_id").select("doc_id", "topic", "sentences", F.md5("content").alias("content_md5"))


@query(f"""with recursive {MD}, p as (select page_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), x -> trim(x)), x -> x <> '') as p from md),
 f(page_id, i, done, now) as (select page_id, 0, cast([] as varchar[]), '' from p union all select f.page_id, i + 1, case when now = '' or length(now) + 2 + length(p[i + 1]) <= 1000 then done else list_append(done, now) end, case when now = '' then p[i + 1] when length(now) + 2 + length(p[i + 1]) <= 1000 then now || chr(10) || chr(10) || p[i + 1] else p[i + 1] end from f join p on p.page_id = f.page_id where i < len(p)),
 e as (select f.page_id, case when now = '' then done else list_append(done, now) end as c from f join p on p.page_id = f.page_id where i = len(p)) select page_id, unnest(range(len(c))) as at, md5(unnest(c)) as content_md5 from e""")
def chunk_paragraphs(t):
    c = _md(t).select("page_id", F.posexplode(layout.paragraphs(F.col("text"))).alias("at", "c"))
    return c.select("page_id", F.col("at").cast("long").alias("at"), F.md5("c").alias("content_md5"))


@query(f"with {SENTENCES}, n as (select doc_id, count(*) as n from sent group by 1) select doc_id, n, round(greatest(cast(0.5 as double), least(cast(0.9 as double), 0.65 - least(n / cast(50 as double), 1) * 0.05)), 6) as threshold from n")
def adaptive_threshold(t):
    n = _sentences(t).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.withColumn("threshold", F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.65 - F.least(F.col("n") / 50.0, F.lit(1.0)) * 0.05)), 6))


_cos = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(f"""with e as (select label, vec_id, cast(embedding as double[]) as x, row_number() over (partition by label order by vec_id) as i from embeddings), p as (select a.label, b.i - a.i as d, {_cos.format(a='a.x', b='b.x')} as c from e a join e b on a.label = b.label and b.i - a.i between 1 and 2)
 select label, round(greatest(cast(0 as double), least(cast(1 as double), 0.7 * avg(c) filter (d = 1) + 0.3 * avg(c))), 5) as coherence from p group by 1""")
def coherence_embedding(t):
    """A label's vectors in order of id stand for a text's sentences: .7 neighbours, .3 pairs up to two apart."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = t.embeddings.select("label", F.col("embedding").alias("x"), F.lead("embedding", 1).over(w).alias("y"), F.lead("embedding", 2).over(w).alias("z"))
    c = e.select("label", F.when(F.col("y").isNotNull(), vx.cosine(F.col("x"), F.col("y"))).alias("one"), F.when(F.col("z").isNotNull(), vx.cosine(F.col("x"), F.col("z"))).alias("two"))
    g = c.groupBy("label").agg(F.avg("one").alias("a"), ((F.sum("one") + F.coalesce(F.sum("two"), F.lit(0.0))) / (F.count("one") + F.count("two"))).alias("b"))
    return g.where("a is not null").select("label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("a") + 0.3 * F.col("b"))), 5).alias("coherence"))


@query(f"""with s as (select doc_id, string_split(regexp_replace(text, '[.!?]+{WS}', chr(1), 'g'), chr(1)) as p from documents), l as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\\n]'), x -> trim(x)), x -> x <> '') as q from documents)
 select s.doc_id, len(list_filter(list_transform(p, x -> trim(x)), x -> x <> '')) as by_pattern, len(q) as by_line, md5(array_to_string(q, '|')) as line_md5 from s join l on l.doc_id = s.doc_id""")
def split_sentences_plain(t):
    """Two more ways: ends and the white space after them dropped, and ends of sentences and of lines alike."""
    p = F.filter(F.transform(F.split("text", f"[.!?]+{WS}", -1), lambda x: F.trim(x)), lambda x: x != "")
    q = F.filter(F.transform(F.split("text", "[.!?\n]", -1), lambda x: F.trim(x)), lambda x: x != "")
    return t.documents.select("doc_id", F.size(p).cast("long").alias("by_pattern"), F.size(q).cast("long").alias("by_line"), F.md5(F.array_join(q, "|")).alias("line_md5"))


@query("select doc_id, case when strlen(text) < 10 then null when " + f"len({WORDS.format('text')}) > 0 and (" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in ("the", "and", "or", "but", "in", "on", "at", "to")) + f") / cast(len({WORDS.format('text')}) as double) > 0.05 then 'en' else 'unknown' end as language from documents")
def detect_language_en(t):
    return t.documents.select("doc_id", tx.language_en(F.col("text")).alias("language"))


_low = f"trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))"
_sem = f"trim(regexp_replace(regexp_replace({_low}, '[^\\p{{L}}\\p{{N}} ]', '', 'g'), '{WS}', ' ', 'g'))"
_con = "list_filter(string_split(sem, ' '), x -> x not in (" + ", ".join(f"'{w}'" for w in tx.CONTENT_STOP_WORDS) + "))"


@query(f"with k as (select doc_id, {_low} as low, {_sem} as sem from documents) select doc_id, sha256(low) as simple, sha256(sem) as semantic, sha256(case when len({_con}) > 0 then array_to_string({_con}, ' ') else sem end) as content from k")
def cache_key_normalise(t):
    return t.documents.select("doc_id", *[tx.cache_key(F.col("text"), m).alias(m) for m in ("simple", "semantic", "content")])


@query("""with p as (select a.p_partkey as id, a.p_name as name, b.asked from part a, (select unnest(['small', 'red gear', 'blu bolt', 'old ring', 'hot widgett']) as asked) b), w as (select *, string_split(lower(name), ' ') as n, string_split(lower(asked), ' ') as q from p)
 select id, asked, case when len(q) = 1 then starts_with(n[1], q[1]) or starts_with(q[1], n[1]) else n[len(n)] = q[len(q)] or levenshtein(lower(name), lower(asked)) <= greatest(1, least(strlen(name), strlen(asked)) // 4) end as matches from w""")
def fuzzy_name_match(t):
    """Five asked names against all parts."""
    asked = t.spark.sql("select explode(array('small', 'red gear', 'blu bolt', 'old ring', 'hot widgett')) as asked")
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).crossJoin(F.broadcast(asked))
    return p.select("id", "asked", tx.edit_name_match(F.col("name"), F.col("asked")).alias("matches"))


# enrichment -------------------------------------------------------------------------------------------------------
ENRICHED = f"""{SECTIONS}, pt as (select h.page_id, h.at, h.title, cast(h.level as integer) as level from hd h), ck as (select page_id, o // 450 as k, o as "offset", substring(text, o + 1, 500) as content, length(text) as size from (select page_id, text, unnest(range(0, greatest(0, length(text)), 450)) as o from md) z),
 en as (select c.page_id, c.k, s.at as section, p.title, p.level, round(c."offset" / cast(c.size as double), 6) as position, length(content) > 150 as summarised, len(list_filter(string_split_regex(lower(content), '{WS}'), x -> strlen(x) > 3)) > 0 as worded from ck c left join sec s on s.page_id = c.page_id and s.start <= c."offset" and c."offset" < s.finish left join pt p on p.page_id = c.page_id and p.at = s.at),
 er as (select page_id, k as at, title as section, level, position, round((case when title is null then 0 else 2 end + 1 + case when summarised then 1 else 0 end + case when worded then 1 else 0 end) / cast(5 as double), 6) as completeness from en)"""


def _enriched(t):
    md = _md(t)
    heads = layout.markdown(md, "page_id")
    c = chunks.fixed(md, "page_id").join(md.select("page_id", F.length("text").alias("size")), "page_id").withColumnRenamed("start_offset", "offset")
    c = layout.section_of(c, layout.sections(heads, md, "page_id"), "page_id")
    c = c.join(heads.select("page_id", F.col("at").alias("section"), "title", "level"), ["page_id", "section"], "left")
    worded = F.size(F.filter(tx.words(F.lower("content")), lambda w: F.octet_length(w) > 3)) > 0
    fields = F.when(F.col("title").isNull(), 0).otherwise(2) + 1 + (F.length("content") > 150).cast("int") + worded.cast("int")
    return c.select("page_id", "at", F.col("title").alias("section"), "level", F.round(F.col("offset") / F.col("size"), 6).alias("position"), F.round(fields / 5.0, 6).alias("completeness"))


@query(f"with {ENRICHED} select * from er")
def enrich_chunks(t):
    """Chunks with their section, its level, their place in the page, and how many of five fields are filled."""
    return _enriched(t)


@query(f"with {ENRICHED} select count(*) as chunks, count(section) as with_section, count(*) filter (completeness > 0.7) as complete, round(avg(completeness), 6) as mean_completeness from er")
def enrichment_stats(t):
    return _enriched(t).agg(F.count("*").alias("chunks"), F.count("section").alias("with_section"), F.sum((F.col("completeness") > 0.7).cast("long")).alias("complete"), F.round(F.avg("completeness"), 6).alias("mean_completeness"))


@query(f"with {ENRICHED}, q as (select page_id, at, round(0.2 * case when contains(lower(section), 'the') then 1 else 0 end + case when completeness > 0.7 then cast(0.05 as double) else 0 end, 6) as boost from er) select page_id, at, boost from q where boost > 0.05")
def metadata_search(t):
    """Chunks whose section the question names, .2, and well described ones, .05; boosts over .05."""
    b = F.round(0.2 * F.coalesce(F.contains(F.lower("section"), F.lit("the")).cast("int"), F.lit(0)) + F.when(F.col("completeness") > 0.7, 0.05).otherwise(0.0), 6)
    return _enriched(t).select("page_id", "at", b.alias("boost")).where("boost > 0.05")


@query(f"with {ENRICHED} select page_id, at, section from er where level = 1")
def filter_by_structure(t):
    return _enriched(t).where("level = 1").select("page_id", "at", "section")
