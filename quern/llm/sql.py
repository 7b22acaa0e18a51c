"""DuckDB SQL for the queries of this subpackage that SQL expresses."""

from __future__ import annotations

from quern.llm.licence import KNOWN, KNOWN_DIGESTS

OP1 = """with p as (select page_id, coalesce(html, '') as html from pages),
 h as (select *, sha1(html) as h, max(page_id) over (partition by html) as top from p)
 select page_id, strlen(html) as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(h, 5 * g + 1, 5) as bigint) >> s) & 31) as integer), 1), '' order by g, s desc)
   from (select unnest(range(8)) as g) a, (select unnest([15, 10, 5, 0]) as s) b) as payload_digest,
  case when page_id is not distinct from top then 'response' else 'revisit' end as record_type, case when page_id is distinct from top then top end as refers_to from h"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TURN = "'<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)"


def _mask(c: str) -> str:
    before = f"list_sum(list_transform({c}[1:i - 1], lambda y: length(y.s)))"
    span = f"cast(coalesce({before}, 0) + 13 + length(replace({c}[i].r, '<|', '< |')) as bigint) || '-' || cast(coalesce({before}, 0) + length({c}[i].s) - 1 as bigint)"
    return f"array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: {c}[i].r = 'assistant'), lambda i: {span}), ',')"


OP3 = f"""with t as (select conv_id, coalesce(turn, 9223372036854775807) as turn, coalesce(role, 'unknown') as r, coalesce(text, '') as t from conversations where conv_id is not null),
 c as (select conv_id, list({{'r': x.r, 't': x.t, 's': {_TURN}}} order by turn, r, t) as turns from t x group by conv_id),
 ids as (select conv_id // 2 as pair_id, max(case when conv_id % 2 = 0 then conv_id end) as chosen_id, max(case when conv_id % 2 = 1 then conv_id end) as rejected_id from c group by 1),
 j as (select ids.*, a.turns as c, b.turns as r from ids left join c a on a.conv_id = chosen_id left join c b on b.conv_id = rejected_id),
 n as (select *, coalesce(len(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: list_aggregate(list_transform(range(1, i + 1), lambda k: c[k].s = r[k].s), 'bool_and'))), 0) as n from j),
 rest as (select *, c[1:n] as p, c[n + 1:] as cr, r[n + 1:] as rr from n)
 select cast(pair_id as bigint) as pair_id, chosen_id, rejected_id, cast(n as integer) as n_prompt_turns, coalesce(array_to_string(list_transform(p, lambda x: x.s), ''), '') as prompt,
  case when c is not null then coalesce(array_to_string(list_transform(cr, lambda x: x.s), ''), '') end as chosen, case when r is not null then coalesce(array_to_string(list_transform(rr, lambda x: x.s), ''), '') end as rejected,
  case when c is not null then coalesce({_mask('cr')}, '') end as chosen_mask, case when r is not null then coalesce({_mask('rr')}, '') end as rejected_mask from rest"""

OP7 = f"""with recursive w as (select doc_id, list_filter(string_split_regex({LOWER}, '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0) x),
 n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
 e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * i >= 80 * (x.n + y.n - i)),
 r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other)
 select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id, min(d.class_id) as class_id from r
 join (select doc_id, min(doc_id) over (partition by case when k is null then cast(doc_id as varchar) else k end) as class_id from (select documents.doc_id, 's' || k as k from documents left join (select doc_id, md5(string_agg(s, chr(1) order by s)) as k from s group by 1) q using (doc_id)) z) d on d.doc_id = r.doc_id
 left join n on n.doc_id = r.doc_id group by d.doc_id"""

_WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8 = f"""with d as (select doc_id, coalesce({_WORDS}, []) as w from documents), b as (select item_id, {_WORDS} as w from benchmark where text is not null),
 win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0) x),
 g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) z) x),
 m as (select g.doc_id, g.i, g.n, win.item_id from g join win on win.n = g.n and win.s = g.s),
 hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) x group by 1),
 items as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as k from (select distinct doc_id, cast(item_id as varchar) as k from m) x group by 1)
 select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(k, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (doc_id) left join items using (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Written for itself, not from the operator's patterns: a line is a notice if it names a holder, a year or (c).
_LAW = "(and|disclaimer|disclaimers|holder|holders|in|interest|interests|is|law|laws|license|licenses|licence|licences|notice|notices|on|or|owner|owners|ownership|permission|permissions|protection|statement|statements|to|treaty|treaties)"
_B = "[ \\t\\r\\f\\v]"
_NOTICE = f"""(regexp_matches(l, '^{_B}*(\\(c\\)|©|all rights reserved)') or regexp_matches(l, '^{_B}*copyright{_B}*(\\(c\\)|©|[0-9][0-9][0-9][0-9])')
  or (regexp_matches(l, '^{_B}*copyright([^\\p{{L}}\\p{{N}}_].*)?[\\p{{L}}\\p{{N}}]') and regexp_matches(l, '^{_B}*copyright([^a-z0-9_]|$)') and regexp_matches(substr(l, 10 + length(l) - length(ltrim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))), '[\\p{{L}}\\p{{N}}]')
   and (not regexp_matches(l, '^{_B}*copyright{_B}+{_LAW}([^a-z0-9_]|$)') or regexp_matches(l, '^{_B}*copyright{_B}+{_LAW}{_B}*:'))))"""
_ALIKE = [("licence", "license"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("modelling", "modeling"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("fulfil ", "fulfill "), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https:", "http:"), ("&", " and ")]


def _canonical(text: str) -> str:
    lines = f"string_split(regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g'), chr(10))"
    sql = f"array_to_string(list_transform({lines}, lambda l: case when {_NOTICE} then ' ' else l end), chr(10))"
    sql = f"regexp_replace(regexp_replace({sql}, '-{_B}*\\n[\\s]*', '-', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')"
    for old, new in _ALIKE:
        sql = f"replace({sql}, {_quoted(old)}, {_quoted(new)})"
    return f"trim(replace(' ' || trim(regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ', ' fulfil ', ' fulfill '))"


_KNOWN = " union all ".join(f"select {_quoted(k)} as licence, {_quoted(v)} as text" for k, v in KNOWN.items())
_DIGESTS = " union all ".join(f"select {_quoted(k)} as licence, {_quoted(v)} as h" for k, v in KNOWN_DIGESTS.items())
OP10 = f"""with texts as (select licence, {_canonical('text')} as c from ({_KNOWN}) k), known as (select h, min(licence) as licence from (select licence, sha256(c) as h from texts where c <> '' union all {_DIGESTS}) x group by 1),
 d as (select doc_id, sha256({_canonical('text')}) as canonical_digest from documents)
 select doc_id, canonical_digest, licence from d left join known on h = canonical_digest"""

OP11 = f"""with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(coalesce({LOWER}, ''), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
 g as (select lang, k, unnest(list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p, (select unnest(range(1, 6)) as k) x),
 f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100), n as (select lang, sum(len(w)) as n from p group by 1),
 longer as (select lang, phrase, max(f) as over from (select lang, f, unnest([array_to_string(string_split(phrase, ' ')[2:], ' '), array_to_string(string_split(phrase, ' ')[:k - 1], ' ')]) as phrase from f where k > 2) x group by 1, 2),
 c as (select f.lang, f.phrase, k, f as a from f left join longer o on o.lang = f.lang and o.phrase = f.phrase where k > 1 and (over is null or 100 * over < 100 * f)),
 cut as (select *, array_to_string(string_split(phrase, ' ')[:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') as rest from (select *, unnest(range(1, k)) as j from c) x),
 s as (select cut.lang, cut.phrase, a, x.f as l, y.f as r, cast(n as bigint) as n, j, cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) as score
  from cut join n on n.lang = cut.lang join f x on x.lang = cut.lang and x.phrase = head join f y on y.lang = cut.lang and y.phrase = rest),
 b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
 select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b qualify rank <= 2000"""

ORACLES: dict[str, str] = {"op1_warc": OP1, "op3_preferences": OP3, "op7_near_duplicates": OP7, "op8_decontamination": OP8, "op10_licences": OP10, "op11_collocations": OP11}
