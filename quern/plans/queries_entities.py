"""Entity, relation and linking queries on chunks and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunks, linking
from quern.operators import entities as en
from quern.plans.registry import query
from quern.sources import fixtures as fx

WS = "[ \\t\\n\\r\\f]+"
_list = lambda names: "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"
_in = lambda names: "(" + _list(names)[1:-1] + ")"
_any = lambda text, names: f"len(list_filter({_list(names)}, x -> contains({text}, x))) > 0"
NAME = "regexp_replace(regexp_replace(w, '[^\\p{L}'']', '', 'g'), '''+$', '')"
CAPITAL = "regexp_matches(w, '^\\p{Lu}')"
CHUNKS = "chunk as (select doc_id, o // 450 as at, substring(text, o + 1, 500) as content from (select doc_id, text, unnest(range(0, greatest(0, length(text)), 450)) as o from documents) z)"
WORDS = f"{CHUNKS}, cw as (select doc_id, at, w, {NAME} as name from (select doc_id, at, unnest(string_split_regex(content, '{WS}')) as w from chunk) z where w <> '')"
NAMES = f"{WORDS}, found as (select distinct doc_id, at, name from cw where {CAPITAL} and strlen(w) > 3 and lower(name) not in {_in(en.COMMON)})"
KEYS = ["doc_id", "at"]


def _chunks(t):
    return chunks.fixed(t.documents).select("doc_id", "at", F.col("content").alias("text"))


@query(f"""with {WORDS} select doc_id, at, count(*) as n from cw where strlen(name) >= 2 and not (strlen(name) <= 2 and lower(name) in {_in(en.SHORT)}) and regexp_matches(name, '^\\p{{Lu}}[\\p{{L}}'']*$')
 and (strlen(name) >= 3 or {' or '.join(f"ends_with(lower(name), '{e}')" for e in en.NAME_ENDS)} or {' or '.join("starts_with(lower(name), '" + b.replace("'", "''") + "')" for b in en.NAME_BEGINS)}) group by 1, 2""")
def person_word_rule(t):
    return en.words_of(_chunks(t)).where(en.person_word(F.col("name"))).groupBy("doc_id", "at").agg(F.count("*").alias("n"))


@query(f"with {NAMES} select doc_id, at, name, cast(0.5 as double) as confidence from found")
def extract_generic(t):
    return en.generic(_chunks(t))


@query(f"""with {WORDS} select doc_id, at, name, max(c) as confidence from (select doc_id, at, name, case when {_any('name', en.CONCEPTS)} then cast(0.75 as double) when {CAPITAL} and strlen(w) > 4 and lower(name) not in {_in(en.COMMON)} then cast(0.6 as double) end as c from cw) x where c is not null group by 1, 2, 3""")
def extract_concepts(t):
    return en.concepts(_chunks(t))


@query(f"with {CHUNKS}, d as (select doc_id, at, content, unnest({_list(en.EVENTS)}) as name from chunk) select doc_id, at, name, cast(0.7 as double) as confidence from d where contains(lower(content), name)")
def extract_events(t):
    return en.dictionary(_chunks(t), en.EVENTS, 0.7)


@query(f"with {CHUNKS}, d as (select doc_id, at, content, unnest({_list(en.OBJECTS)}) as name from chunk) select doc_id, at, name, cast(0.65 as double) as confidence from d where contains(lower(content), name)")
def extract_objects(t):
    return en.dictionary(_chunks(t), en.OBJECTS, 0.65)


@query(f"with d as (select page_id, html, unnest({_list(en.LOCATIONS)}) as name from pages) select page_id, name, cast(0.5 as double) as confidence from d where contains(html, name)")
def extract_locations(t):
    return en.dictionary(t.pages.select("page_id", F.col("html").alias("text")), en.LOCATIONS, 0.5, any_case=False)


def organisations_sql(table: str, text: str, keys: str) -> str:
    return f"""e as (select {keys}, {text} as text, unnest({_list(en.ORGANISATION_ENDS)}) as mark from {table}), o1 as (select {keys}, trim(list_extract(string_split(substring(text, 1, strpos(text, mark) - 1), ' '), -1) || mark) as name from e where contains(text, mark)),
 b as (select {keys}, mark, substring(text, strpos(text, mark)) as rest from (select {keys}, {text} as text, unnest({_list(en.ORGANISATION_BEGINS)}) as mark from {table}) z where contains(text, mark)),
 o2 as (select {keys}, mark, trim(case when contains(rest, '.') then string_split(rest, '.')[1] else substring(rest, 1, 50) end) as name from b),
 org as (select {keys}, name from o1 where {_any('name', en.ORGANISATION_MARKS)} union select {keys}, name from o2 where length(name) > length(mark))"""


ORGANISATIONS = organisations_sql("documents", "text", "doc_id")


@query(f"with {ORGANISATIONS} select doc_id, name from org")
def extract_organizations(t):
    return en.organisations(t.documents.select("doc_id", "text"))


_CAP1 = "case when regexp_matches(name, '^\\p{Lu}') then cast(0.1 as double) else 0 end"
CONFIDENCE = f"""round(least(cast(1 as double), cast(0.5 as double) + case kind when 'PERSON' then (case when contains(name, 'Dr.') or contains(name, 'Prof.') then cast(0.3 as double) else 0 end) + (case when len(list_filter(string_split_regex(name, '{WS}'), x -> x <> '')) = 2 then cast(0.2 as double) else 0 end)
 when 'ORGANIZATION' then (case when contains(name, 'Inc') or contains(name, 'Corp') or contains(name, 'LLC') then cast(0.3 as double) else 0 end) + (case when contains(name, 'University') or contains(name, 'Institute') then cast(0.2 as double) else 0 end)
 when 'LOCATION' then (case when contains(name, ',') then cast(0.2 as double) else 0 end) + (case when name in {_in(en.LOCATIONS)} then cast(0.3 as double) else 0 end) else 0 end + {_CAP1}), 6)"""


@query(f"with n as (select id, name, unnest(['PERSON', 'ORGANIZATION', 'LOCATION', 'THING']) as kind from (with {fx.ENTITIES} select id, name from entities) z) select id, kind, {CONFIDENCE} as confidence from n")
def entity_confidence(t):
    n = fx.entities(t).select("id", "name", F.explode(F.array(*[F.lit(k) for k in ("PERSON", "ORGANIZATION", "LOCATION", "THING")])).alias("kind"))
    return n.select("id", "kind", F.round(en.confidence(F.col("name"), F.col("kind")), 6).alias("confidence"))


@query(f"""with {NAMES}, p as (select f.doc_id, f.at, f.name, string_split(content, f.name) as parts from found f join chunk c on c.doc_id = f.doc_id and c.at = f.at),
 s as (select doc_id, at, name, unnest(range(1, len(parts))) as k, parts from p)
 select doc_id, at, 'CONCEPT_' || regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') as id, name, cast(list_sum(list_transform(parts[1:k], x -> length(x))) as bigint) + (k - 1) * length(name) as start, cast(list_sum(list_transform(parts[1:k], x -> length(x))) as bigint) + k * length(name) as "end" from s""")
def entity_mentions(t):
    """Where each name of a chunk stands in it."""
    c = _chunks(t)
    m = en.mentions(en.generic(c).select("doc_id", "at", "name").join(c, ["doc_id", "at"]))
    return m.select("doc_id", "at", en.entity_id(F.lit("CONCEPT"), F.col("name")).alias("id"), "name", "start", "end")


@query(f"with {NAMES} select doc_id, at, name from found where (regexp_matches(name, '^[A-M]') or regexp_matches(name, 'on$')) and not regexp_matches(name, '^An') and not regexp_matches(name, 'th')")
def pattern_filter(t):
    return en.pattern_filter(en.generic(_chunks(t)), ["^[A-M]", "on$"], ["^An", "th"]).select("doc_id", "at", "name")


@query(f"with {NAMES} select a.name as name, b.name as other, count(*) as shared from found a join found b on a.doc_id = b.doc_id and a.at = b.at and a.name < b.name group by 1, 2")
def extract_relationships(t):
    """Every two names that share a chunk, and how many."""
    return en.co_mentions(en.generic(_chunks(t)), KEYS)


CONCEPT_GRAPH = f"{NAMES}, own as (select name, count(*) as n from found group by 1), rel as (select a.name as name, b.name as other, count(*) as shared from found a join found b on a.doc_id = b.doc_id and a.at = b.at and a.name < b.name group by 1, 2)"


@query(f"with {CONCEPT_GRAPH} select r.name, r.other, r.shared, round(r.shared / cast(x.n + y.n - r.shared as double), 6) as confidence from rel r join own x on x.name = r.name join own y on y.name = r.other")
def concept_graph_build(t):
    return en.concept_relations(en.generic(_chunks(t)), KEYS)


FACT_TYPE = "case when regexp_matches(name, '^\\p{Lu}') then case when ends_with(lower(name), 'ia') or ends_with(lower(name), 'land') or ends_with(lower(name), 'istan') then 'LOCATION' else 'PERSON' end when regexp_matches(name, '[0-9]') then 'DATE' else 'CONCEPT' end"
CORPUS_TYPE = "case when contains(lower(name), 'company') or contains(lower(name), 'corp') or contains(lower(name), 'inc') then 'organization' when regexp_matches(name, '^\\p{Lu}') and not contains(name, ' ') then 'person' when contains(lower(name), 'city') or contains(lower(name), 'country') then 'location' else 'other' end"
GUESS = f"""case when contains(lower(name), 'person') then 'person' when contains(lower(name), 'organization') then 'organization' when contains(lower(name), 'location') then 'location' when contains(lower(name), 'concept') then 'concept'
 when ends_with(lower(name), 'company') or ends_with(lower(name), 'corp') or ends_with(lower(name), 'inc') then 'organization' when contains(lower(name), 'city') or contains(lower(name), 'country') or contains(lower(name), 'state') then 'location'
 when len(list_filter(string_split_regex(name, '{WS}'), x -> x <> '')) = 1 and strlen(name) < 20 then 'person' else 'other' end"""


@query(f"with {NAMES}, n as (select distinct name from found union select distinct p_name from part) select name, {FACT_TYPE} as fact_type, {CORPUS_TYPE} as corpus_type, {GUESS} as guess from n")
def infer_entity_type(t):
    """The three rules for a name's type."""
    n = en.generic(_chunks(t)).select("name").union(t.part.select("p_name")).distinct()
    return n.select("name", en.type_of_fact(F.col("name")).alias("fact_type"), en.type_in_corpus(F.col("name")).alias("corpus_type"), en.type_by_guess(F.col("name")).alias("guess"))


TYPED = f"{NAMES}, typed as (select doc_id, at, name, {FACT_TYPE} as kind from found), pair as (select a.doc_id, a.at, a.name, b.name as other, a.kind, b.kind as other_kind, c.content from typed a join typed b on a.doc_id = b.doc_id and a.at = b.at and a.name < b.name join chunk c on c.doc_id = a.doc_id and c.at = a.at)"


def _typed(t):
    return en.generic(_chunks(t)).withColumn("entity_type", en.type_of_fact(F.col("name")))


@query(f"""with {TYPED} select name, other, case when (kind = 'PERSON' and other_kind = 'LOCATION') or (kind = 'LOCATION' and other_kind = 'PERSON') then case when contains(content, 'born in') or contains(content, 'from') then 'BORN_IN' when contains(content, 'lives in') or contains(content, 'based in') then 'LOCATED_IN' else 'ASSOCIATED_WITH' end
 when kind = 'PERSON' and other_kind = 'PERSON' then case when contains(content, 'married') or contains(content, 'spouse') then 'MARRIED_TO' when contains(content, 'colleague') or contains(content, 'partner') then 'COLLEAGUE_OF' else 'KNOWS' end else 'RELATED_TO' end as relation_type, count(*) as n from pair group by 1, 2, 3""")
def infer_relation_type(t):
    p = en.pairs_of(_typed(t).select("doc_id", "at", "name", "entity_type"), KEYS).join(_chunks(t), KEYS)
    kind = en.relation_by_types(F.col("entity_type"), F.col("other_entity_type"), F.col("text"))
    return p.groupBy("name", "other", kind.alias("relation_type")).agg(F.count("*").alias("n"))


def _window_sql() -> str:
    has = lambda marks: " or ".join(f"contains(win, '{m}')" for m in marks)
    out = ""
    for kinds, rules in en.WINDOW_RULES:
        test = " or ".join(f"(kind = '{x}' and other_kind = '{y}')" for x, y in kinds)
        out += f" when {test} then case " + " ".join(f"when {has(m)} then '{r}|{c}'" if m else f"else '{r}|{c}'" for m, r, c in rules if m or len(rules) > 1) + " end" if len(rules) > 1 else f" when {test} then '{rules[0][1]}|{rules[0][2]}'"
    return f"case{out} when abs(pa - pb) < 100 then 'CO_OCCURS|0.5' end"


@query(f"""with {TYPED}, p1 as (select *, strpos(lower(content), lower(name)) as pa, strpos(lower(content), lower(other)) as pb from pair), p2 as (select *, substring(lower(content), least(pa, pb), abs(pa - pb) + 50) as win from p1 where pa > 0 and pb > 0), r as (select *, {_window_sql()} as r from p2)
 select doc_id, at, name, other, string_split(r, '|')[1] as relation_type, cast(string_split(r, '|')[2] as double) as confidence from r where r is not null""")
def relationships_fallback(t):
    return en.window_relations(_chunks(t), _typed(t))


INDEXED = f"""{CHUNKS}, ws as (select doc_id, at, list_filter(string_split_regex(content, '{WS}'), x -> x <> '') as l from chunk), three as (select doc_id, at, l[i:i + 2] as g from (select doc_id, at, l, unnest(range(1, len(l) - 1)) as i from ws) z),
 ix0 as (select doc_id, at, array_to_string(g, ' ') as name, cast(0.6 as double) as c from three where len(list_filter(g, x -> regexp_matches(x, '^\\p{{Lu}}'))) = 3 union all select doc_id, at, w, cast(0.5 as double) from (select doc_id, at, unnest(l) as w from ws) z where {CAPITAL} and strlen(w) > 2),
 ix as (select doc_id, at, name, max(c) as confidence from ix0 group by 1, 2, 3)"""


@query(f"with {INDEXED} select doc_id, at, name, confidence, {GUESS} as entity_type from ix")
def graph_indexer_extract(t):
    return en.indexed(_chunks(t))


def _phrase_sql() -> str:
    return "case " + " ".join(f"when contains(mid, '{p}') then '{r}|{c}'" for p, r, c in en.PHRASES) + " end"


@query(f"""with {INDEXED}, k as (select *, {GUESS} as kind from ix), pr as (select a.doc_id, a.at, a.name, b.name as other, a.kind, b.kind as other_kind, strpos(lower(content), lower(a.name)) as pa, strpos(lower(content), lower(b.name)) as pb, lower(content) as low
 from k a join k b on a.doc_id = b.doc_id and a.at = b.at and a.name < b.name join chunk c on c.doc_id = a.doc_id and c.at = a.at), m as (select *, substring(low, least(pa, pb), abs(pa - pb)) as mid, pa < pb as fwd from pr where pa > 0 and pb > 0),
 h as (select *, {_phrase_sql()} as hit from m), s as (select *, string_split(hit, '|')[1] as rel, cast(string_split(hit, '|')[2] as double) as base, case when fwd then kind else other_kind end as k1, case when fwd then other_kind else kind end as k2 from h where hit is not null)
 select distinct doc_id, at, case when not fwd and rel not in ('works_at', 'located_in', 'from') then other else name end as source, case when not fwd and rel not in ('works_at', 'located_in', 'from') then name else other end as target, rel as relation_type,
 round(least(cast(1 as double), base + case when rel in ('works_at', 'founded') and k1 = 'person' and k2 = 'organization' then cast(0.2 as double) when rel = 'located_in' and k2 = 'location' then cast(0.2 as double) when rel = 'manages' and k1 = 'person' then cast(0.1 as double) else 0 end), 6) as confidence from s""")
def graph_indexer_relations(t):
    c = _chunks(t)
    return en.phrase_relations(c, en.indexed(c))


FACTS = """fact as (select 'Customer ' || cast(o_custkey as varchar) as subject, case o_orderstatus when 'F' then 'caused' when 'O' then 'was allowed' else 'placed' end as predicate, case when o_orderkey % 3 = 0 then 'Orderland' else 'order ' || cast(o_orderkey as varchar) end as object, cast(0.5 as double) + (o_orderkey % 50) / cast(100 as double) as confidence,
 case o_orderkey % 4 when 0 then 'in ' || cast(1200 + o_orderkey % 900 as varchar) when 1 then cast(1 + o_orderkey % 500 as varchar) || ' BC' when 2 then 'long ago' end as marker from orders),
 year as (select *, try_cast(nullif(regexp_replace(marker, '[^0-9]', '', 'g'), '') as bigint) as y from fact),
 dated as (select *, case when contains(marker, 'BC') then -y * 31536000 when y > 1000 and y < 3000 then (y - 1970) * 31536000 end as moment from year)"""
_ID = "regexp_replace(replace(lower(trim({})), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _facts(t):
    k = F.col("o_orderkey")
    marker = F.when(k % 4 == 0, F.concat(F.lit("in "), (1200 + k % 900).cast("string"))).when(k % 4 == 1, F.concat((1 + k % 500).cast("string"), F.lit(" BC"))).when(k % 4 == 2, "long ago")
    return t.orders.select(F.concat(F.lit("Customer "), "o_custkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "caused").when(F.col("o_orderstatus") == "O", "was allowed").otherwise("placed").alias("predicate"),
        F.when(k % 3 == 0, "Orderland").otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("object"), (F.lit(0.5) + (k % 50) / F.lit(100.0)).alias("confidence"), marker.alias("marker"))


@query(f"""with {FACTS}, ends as (select subject as name, confidence, moment from dated union all select object, confidence, moment from dated), g as (select {_ID.format('name')} as id, min(name) as name, max(confidence) as confidence, min(moment) as first_mentioned, max(moment) as last_mentioned from ends group by 1)
 select *, {FACT_TYPE} as entity_type from g""")
def atomic_facts_entities(t):
    return en.facts_to_graph(_facts(t))[0]


@query(f"""with {FACTS} select {_ID.format('subject')} as source, {_ID.format('object')} as target, upper(predicate) as relation_type, confidence, moment as range_start, case when moment is null then null when predicate = 'caused' then 'Caused' when predicate = 'was allowed' then 'Enabled' end as temporal_type,
 round(case when moment is null then null when predicate = 'caused' then confidence when predicate = 'was allowed' then confidence * 0.6 end, 6) as causal_strength from dated""")
def atomic_facts_relationships(t):
    return en.facts_to_graph(_facts(t))[1]


@query("select lower(c_mktsegment) as key, arg_max(c_name, {'n': length(c_name || ' of nation ' || cast(c_nationkey as varchar)), 'k': -c_custkey}) as name, max(length(c_name || ' of nation ' || cast(c_nationkey as varchar))) as size, count(*) as rows from customer group by 1")
def merge_entity_data(t):
    """Of the rows of one key, the name with the longest description stays, the first of equals."""
    d = t.customer.select(F.lower("c_mktsegment").alias("key"), F.col("c_name").alias("name"), F.length(F.concat(F.col("c_name"), F.lit(" of nation "), F.col("c_nationkey").cast("string"))).cast("long").alias("n"), (-F.col("c_custkey")).alias("o"))
    return d.groupBy("key").agg(F.max_by("name", F.struct("n", "o")).alias("name"), F.max("n").alias("size"), F.count("*").alias("rows"))


@query("select 'SUPPLIER_' || cast(l_suppkey as varchar) as source, 'PART_' || cast(l_partkey as varchar) as target, l_returnflag as relation_type, min(l_orderkey * 10 + l_linenumber) as first_row from lineitem group by 1, 2, 3")
def dedupe_relationships(t):
    """The first row of each source, target and type."""
    return linking.first_of(t.lineitem.select(F.concat(F.lit("SUPPLIER_"), "l_suppkey").alias("source"), F.concat(F.lit("PART_"), "l_partkey").alias("target"), F.col("l_returnflag").alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row")), ["source", "target", "relation_type"], "first_row")


# linking: the parts' names, many of which are equal or nearly so ---------------------------------------------
PART_NAMES = "pn as (select lower(p_name) as name, count(*) as n, min(p_partkey) as id from part group by 1)"


@query("select p_partkey as id, lower(p_name) as name, count(*) over (partition by lower(p_name)) as members, min(p_partkey) over (partition by lower(p_name)) as canonical_id, cast(1 as double) as confidence from part qualify count(*) over (partition by lower(p_name)) > 1")
def corpus_link_exact(t):
    return linking.link_exact(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""with n as (select r_name as name from region union all select s_name from supplier), q as (select unnest(['supplier#000000001', 'Europ', 'Supplier#000000099', 'nobody']) as asked),
 s as (select q.asked, n.name, lower(n.name) = lower(q.asked) as same, levenshtein(lower(n.name), lower(q.asked)) as d, greatest(strlen(n.name), strlen(q.asked)) as l from q, n), r as (select asked, name, case when same then 1 when d > 2 then 0 else 1 - d / cast(l as double) end as score from s)
 select asked, name, round(score, 6) as score from (select *, row_number() over (partition by asked order by score desc, name) as rn from r where score >= 0.85) x where rn = 1""")
def find_canonical_entity(t):
    """The known name for each asked one: equal but for case, else the most similar of at least .85."""
    names = t.region.select(F.col("r_name").alias("name")).union(t.supplier.select("s_name"))
    asked = t.spark.sql("select explode(array('supplier#000000001', 'Europ', 'Supplier#000000099', 'nobody')) as asked")
    return linking.find_canonical(asked, names)


@query("select p_brand as cluster, arg_max(name, {'c': n, 'l': length(name), 'k': name}) as canonical_name, cast(sum(n) as bigint) as members from (select p_brand, p_name as name, count(*) as n from part group by 1, 2) x group by 1")
def canonical_name(t):
    """The most frequent name of a cluster, of equals the longest."""
    return linking.canonical_names(t.part.select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")))


@query("""with o as (select p_brand || p_type as cluster, p_partkey as id, p_name as name, cast(0.5 as double) + (p_partkey % 50) / cast(100 as double) as confidence from part)
 select cluster, min(id) as id, arg_max(name, {'l': length(name), 'c': confidence, 'i': -id}) as name, count(*) as members, round(greatest(avg(confidence), cast(0.8 as double)), 6) as confidence from o group by 1 having count(*) > 1""")
def merge_entities(t):
    """The first id, the longest name, and the surer of the members' mean and the decision."""
    o = t.part.select(F.concat("p_brand", "p_type").alias("cluster"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.lit(0.5) + (F.col("p_partkey") % 50) / F.lit(100.0)).alias("confidence"))
    return linking.merge_clusters(o, 0.8)


def _similarity_sql(a: str, b: str) -> str:
    w = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '{WS}'), x -> x <> ''))"
    return f"case when {a} = {b} then cast(1 as double) when contains({a}, {b}) or contains({b}, {a}) then cast(0.9 as double) else len(list_intersect({w(a)}, {w(b)})) / cast(len(list_distinct(list_concat({w(a)}, {w(b)}))) as double) end"


@query(f"""with c as (select p_brand as kind, lower(p_name) as name from part), d as (select distinct kind, name from c), s as (select a.kind, a.name as a, b.name as b, {_similarity_sql('a.name', 'b.name')} as s from d a join d b on a.kind = b.kind and a.name < b.name)
 select kind, count(*) as pairs, round(avg(s), 6) as mean_similarity, avg(s) > 0.8 as merge from s group by 1""")
def merge_decision(t):
    """Whether a group of one type is one entity: the mean similarity of its distinct names over .8."""
    return linking.merge_decisions(t.part.select(F.col("p_brand").alias("kind"), F.lower("p_name").alias("name")))


@query("""with known as (select lower(p_name) as name, min(p_partkey) as cluster from part where p_partkey % 2 = 0 group by 1), new as (select p_partkey as id, lower(p_name) || case when p_partkey % 10 = 1 then ' xl' else '' end as name from part where p_partkey % 2 = 1)
 select new.id, new.name, coalesce(known.cluster, min(new.id) over (partition by new.name)) as cluster, case when known.cluster is null then cast(0.8 as double) else 1 end as confidence from new left join known on known.name = new.name""")
def corpus_link_incremental(t):
    """New rows go to the cluster that has their name, or found one of their own."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    new = p.where("id % 2 = 1").withColumn("name", F.when(F.col("id") % 10 == 1, F.concat("name", F.lit(" xl"))).otherwise(F.col("name")))
    return linking.link_incremental(p.where("id % 2 = 0").groupBy("name").agg(F.min("id").alias("cluster")), new)


@query()
def link_entities(t):
    """Clusters of similar names within a type, each a seed and what is near it; see tests for the same by brute force."""
    return linking.link_similar(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), (F.lit(0.5) + (F.col("p_partkey") % 50) / F.lit(100.0)).alias("confidence")))


@query()
def corpus_link_fuzzy(t):
    return linking.link_fuzzy(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 0.85)


@query()
def corpus_link_semantic(t):
    return linking.link_fuzzy(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 0.85 * 0.8)


@query()
def corpus_link_hybrid(t):
    return linking.link_hybrid(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


# the index from names to chunks and back ----------------------------------------------------------------------
@query(f"with {NAMES}, top as (select name from found group by 1 order by count(*) desc, name limit 5) select name, doc_id, at from found where name in (select name from top)")
def chunks_for_entity(t):
    f = en.generic(_chunks(t)).select("name", "doc_id", "at")
    top = f.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5).select("name")
    return f.join(F.broadcast(top), "name", "left_semi")


@query(f"with {NAMES} select doc_id, at, string_agg(name, ',' order by name) as names, count(*) as n from found group by 1, 2")
def entities_for_chunk(t):
    return en.generic(_chunks(t)).groupBy("doc_id", "at").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"), F.countDistinct("name").alias("n"))


@query(f"with {NAMES} select doc_id, at, count(*) as n from found group by 1, 2 having count(*) >= 10")
def dense_chunks(t):
    return en.generic(_chunks(t)).groupBy("doc_id", "at").agg(F.count("*").alias("n")).where("n >= 10")


@query(f"with {NAMES} select a.doc_id, a.at, a.name from found a join found b on b.doc_id = a.doc_id and b.at = a.at + 1 and b.name = a.name")
def common_entities(t):
    """Names that a chunk and the next one share."""
    f = en.generic(_chunks(t)).select("doc_id", "at", "name")
    return f.join(f.select("doc_id", (F.col("at") - 1).alias("at"), "name"), ["doc_id", "at", "name"])


@query(f"with {NAMES} select count(distinct name) as entities, count(distinct doc_id * 1000000 + at) as chunks, count(*) as links, round(count(*) / cast(count(distinct name) as double), 6) as chunks_per_entity from found")
def index_stats(t):
    f = en.generic(_chunks(t))
    return f.agg(F.countDistinct("name").alias("entities"), F.countDistinct(F.col("doc_id") * 1000000 + F.col("at")).alias("chunks"), F.count("*").alias("links"), F.round(F.count("*") / F.countDistinct("name"), 6).alias("chunks_per_entity"))
