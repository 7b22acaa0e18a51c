"""Chunks by meaning and persons over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunks, entities as en, persons as ps, segments
from quern.plans.queries_entities import CAPITAL, CHUNKS, CONFIDENCE, NAME, WORDS as CHUNK_WORDS, WS, _any, _chunks, _in, _list, organisations_sql
from quern.plans.queries_text import SENTENCES, WORDS
from quern.plans.registry import query

ALL_SENTENCES = SENTENCES.replace("length(s) > 5", "length(s) > 0")
DISTANCES = f"""{ALL_SENTENCES}, sw as (select doc_id, at, s, list_distinct({WORDS.format('lower(s)')}) as w from sent), sp as (select *, lead(w) over (partition by doc_id order by at) as v from sw),
 sd as (select doc_id, at, case when v is not null then round(1 - case when len(w) * len(v) > 0 then len(list_intersect(w, v)) / sqrt(cast(len(w) * len(v) as double)) else 0 end, 9) end as d from sp),
 arr as materialized (select doc_id, count(*) as n, coalesce(list(d order by at) filter (d is not null), []) as ds from sd group by 1)"""
LIMITS = {
    "percentile": "list_sort(ds)[least(cast(floor(len(ds) * 95.0 / 100.0) as bigint), len(ds) - 1) + 1]",
    "deviation": "round(list_sum(ds) / len(ds) + 1.5 * sqrt(greatest(list_sum(list_transform(ds, x -> x * x)) / len(ds) - (list_sum(ds) / len(ds)) * (list_sum(ds) / len(ds)), 0)), 9)",
    "absolute": "cast(0.9 as double)",
}


def _semantic_sql(how: str, least: int, most: int) -> str:
    return f"""with recursive {DISTANCES}, lim as (select doc_id, n, ds, {LIMITS[how]} as lim from arr),
 en as materialized (select doc_id, list_append(list_filter(list_transform(range(1, len(ds) + 1), i -> case when ds[i] > lim then i end), x -> x is not null), n) as ends from lim),
 f(doc_id, k, cuts) as (select doc_id, 0, cast([] as bigint[]) from en union all select f.doc_id, k + 1, case when ends[k + 1] - coalesce(cuts[len(cuts)], 0) >= {least} then list_append(cuts, ends[k + 1]) when k + 1 < len(ends) then cuts when len(cuts) > 0 then list_append(cuts[1:len(cuts) - 1], ends[k + 1]) else [ends[k + 1]] end from f join en on en.doc_id = f.doc_id where k < len(ends)),
 c as materialized (select f.doc_id, unnest(list_transform(range(1, len(cuts) + 1), i -> {{'a': coalesce(cuts[i - 1], 0), 'b': cuts[i]}})) as x from f join en on en.doc_id = f.doc_id where k = len(ends)),
 g as (select doc_id, unnest(list_transform(range(x.a, x.b, {most or 1 << 40}), a -> {{'a': a, 'b': least(a + {most or 1 << 40}, x.b)}})) as x from c)
 select g.doc_id, x.a as first, x.b as "end", md5(string_agg(s, ' ' order by at)) as content_md5 from g join sw on sw.doc_id = g.doc_id and at > x.a and at <= x.b group by 1, 2, 3""".replace("i -> ", "lambda i: ").replace("a -> ", "lambda a: ")


def _semantic(t, **rules):
    made = segments.semantic(t.documents, **rules)
    return made.select("doc_id", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("end"), F.md5("content").alias("content_md5"))


@query(_semantic_sql("percentile", 2, 8))
def chunk_semantic(t):
    """Breaks at the distances above the 95th percentile; two to eight sentences a chunk."""
    return _semantic(t, least=2, most=8)


@query(_semantic_sql("deviation", 1, 0))
def chunk_semantic_deviation(t):
    return _semantic(t, how="deviation", amount=1.5)


@query(_semantic_sql("absolute", 3, 20))
def chunk_similarity(t):
    """Sentences go on while they are like the last; chunks of less than three sentences join the next."""
    return _semantic(t, how="absolute", amount=0.9, least=3, most=20)


@query()
def chunk_boundary_aware(t):
    """The best segmentation by coherence and paragraphs; a test holds it against brute force."""
    return chunks.chunk(t.documents, segments.coherent())


PERSON_RULES = f"""ct as (select doc_id, at, w, {NAME} as name, row_number() over (partition by doc_id, at order by i) - 1 as i from (select doc_id, at, unnest(ws) as w, unnest(range(len(ws))) as i from (select doc_id, at, list_filter(string_split_regex(content, '{WS}'), x -> x <> '') as ws from chunk) y) z),
 tk as materialized (select doc_id, at, i, name, lower(name) as low, {CAPITAL} and strlen(name) >= 2 and not (strlen(name) <= 2 and lower(name) in {_in(en.SHORT)}) and regexp_matches(name, '^\\p{{Lu}}[\\p{{L}}'']*$') and (strlen(name) >= 3 or {' or '.join(f"ends_with(lower(name), '{e}')" for e in en.NAME_ENDS)} or {' or '.join("starts_with(lower(name), '" + b.replace("'", "''") + "')" for b in en.NAME_BEGINS)}) as p,
  lower(name) in {_in(ps.NO_PERSON)} as s, lower(name) in {_in(en.TITLES)} as t from ct),
 ky as (select a.doc_id, a.at, a.i from tk a join tk b on b.doc_id = a.doc_id and b.at = a.at and b.i = a.i + 1 where a.low || ' ' || b.low in {_in(ps.KNOWN)}),
 kt as (select doc_id, at, i, i - row_number() over (partition by doc_id, at order by i) as isl from ky), k1 as (select doc_id, at, i from (select *, row_number() over (partition by doc_id, at, isl order by i) as q from kt) z where q % 2 = 1),
 u1 as (select doc_id, at, i from k1 union select doc_id, at, i + 1 from k1),
 f1 as materialized (select tk.*, u1.i is not null as u from tk left join u1 on u1.doc_id = tk.doc_id and u1.at = tk.at and u1.i = tk.i),
 tc as (select *, case when t and not u and n1 then case when n2 then 3 else 2 end end as len from (select *, coalesce(lead(p and not u, 1) over w, false) as n1, coalesce(lead(p and not u, 2) over w, false) as n2 from f1 window w as (partition by doc_id, at order by i)) z),
 tl as materialized (select doc_id, at, list({{'i': i, 'len': len}} order by i) as c from tc where len is not null group by 1, 2),
 tr(doc_id, at, k, free, i, len) as (select doc_id, at, 0, cast(0 as bigint), cast(null as bigint), 0 from tl union all select tr.doc_id, tr.at, k + 1, case when c[k + 1].i >= free then c[k + 1].i + c[k + 1].len else free end, case when c[k + 1].i >= free then c[k + 1].i end, c[k + 1].len from tr join tl on tl.doc_id = tr.doc_id and tl.at = tr.at where k < len(c)),
 t1 as (select doc_id, at, i, len from tr where i is not null), u2 as (select doc_id, at, unnest(range(i, i + len)) as i from t1),
 f2 as materialized (select f1.* replace (f1.u or u2.i is not null as u) from f1 left join u2 on u2.doc_id = f1.doc_id and u2.at = f1.at and u2.i = f1.i),
 el as (select *, i - row_number() over (partition by doc_id, at order by i) as isl from f2 where p and not s and not u), pr as (select *, row_number() over (partition by doc_id, at, isl order by i) as q, count(*) over (partition by doc_id, at, isl) as m from el),
 names as (select k1.doc_id, k1.at, k1.i as place, string_agg(upper(name[1]) || lower(name[2:]), ' ' order by tk.i) as name, 'known' as rule from k1 join tk on tk.doc_id = k1.doc_id and tk.at = k1.at and tk.i between k1.i and k1.i + 1 group by 1, 2, 3
  union all select t1.doc_id, t1.at, t1.i, string_agg(name, ' ' order by tk.i), 'title' from t1 join tk on tk.doc_id = t1.doc_id and tk.at = t1.at and tk.i between t1.i + 1 and t1.i + t1.len - 1 group by 1, 2, 3
  union all select a.doc_id, a.at, a.i, a.name || ' ' || b.name, 'two' from pr a join pr b on b.doc_id = a.doc_id and b.at = a.at and b.i = a.i + 1 where a.q % 2 = 1
  union all select doc_id, at, i, name, 'one' from pr where q = m and q % 2 = 1)"""


@query(f"with recursive {CHUNKS}, {PERSON_RULES} select doc_id, at, cast(place as integer) as place, name, rule, case rule when 'known' then cast(0.95 as double) when 'title' then cast(0.9 as double) when 'two' then cast(0.8 as double) else cast(0.6 as double) end as confidence from names")
def extract_persons(t):
    return ps.persons(_chunks(t))


EXTRACTED = f"""{CHUNK_WORDS}, {PERSON_RULES}, {organisations_sql('chunk', 'content', 'doc_id, at')}, every as (select doc_id, at, name, 'CONCEPT' as kind, case when {_any('name', en.CONCEPTS)} then cast(0.75 as double) when {CAPITAL} and strlen(w) > 4 and lower(name) not in {_in(en.COMMON)} then cast(0.6 as double) end as c from cw
 union all select doc_id, at, name, 'PERSON', case rule when 'known' then cast(0.95 as double) when 'title' then cast(0.9 as double) when 'two' then cast(0.8 as double) else cast(0.6 as double) end from names
 union all select doc_id, at, name, kind, {CONFIDENCE} from (select *, 'ORGANIZATION' as kind from org) x
 union all select * from (select doc_id, at, unnest({_list(en.EVENTS)}) as name, 'EVENT', cast(0.7 as double) from chunk) x where exists (select 1 from chunk k where k.doc_id = x.doc_id and k.at = x.at and contains(lower(k.content), x.name))
 union all select * from (select doc_id, at, unnest({_list(en.OBJECTS)}) as name, 'OBJECT', cast(0.65 as double) from chunk) x where exists (select 1 from chunk k where k.doc_id = x.doc_id and k.at = x.at and contains(lower(k.content), x.name))
 union all select * from (select doc_id, at, unnest({_list(en.LOCATIONS)}) as name, 'LOCATION', cast(0.9 as double) from chunk) x where exists (select 1 from chunk k where k.doc_id = x.doc_id and k.at = x.at and contains(k.content, x.name))),
 x as (select doc_id, at, name, kind, max(c) as confidence from every where c >= 0.5 group by 1, 2, 3, 4)"""


@query(f"with recursive {EXTRACTED} select name, kind as entity_type, count(*) as rows, max(confidence) as confidence from x group by 1, 2")
def dedupe_entities(t):
    """All extracted entities of all chunks by name and type."""
    return en.dedupe(ps.extract(_chunks(t)))


@query(f"with recursive {EXTRACTED} select kind || '_' || lower(name) as id, min(name) as name, count(*) as rows, max(confidence) as confidence from x group by 1")
def dedupe_entities_ci(t):
    return en.dedupe(ps.extract(_chunks(t)), any_case=True)


@query(f"with recursive {EXTRACTED} select kind as entity_type, count(*) as mentions, count(distinct name) as names, round(cast(sum(cast(confidence as decimal(18, 6))) as double) / count(*), 6) as mean_confidence from x group by 1")
def ner_dataset_stats(t):
    return ps.extract(_chunks(t)).groupBy("entity_type").agg(F.count("*").alias("mentions"), F.countDistinct("name").alias("names"), F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("mean_confidence"))
