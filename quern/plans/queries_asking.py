"""Queries that ask: analysis, routing, rewriting, decomposition, logic forms and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import asking as ask
from quern.plans.registry import query
from quern.sources import fixtures as fx

A, E, R = fx.ASKED, fx.ENTITIES, fx.RELATIONSHIPS
WS = "[ \\t\\n\\r\\f]+"
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda names: "[" + ", ".join(map(_lit, names)) + "]"
_has = lambda c, marks: "(" + " or ".join(f"contains({c}, {_lit(m)})" for m in marks) + ")" if marks else "false"
_count = lambda c, marks: f"len(list_filter({_list(marks)}, x -> contains({c}, x)))"
W = f"list_filter(string_split_regex({{}}, '{WS}'), x -> x <> '')"
TEXTS = f"{A}, texts as (select ask_id, text from asked union all select cast(1000 + item_id as integer), text from benchmark)"


def texts(t):
    """The questions and the benchmark's texts."""
    return fx.asked(t).union(t.benchmark.select((1000 + F.col("item_id")).cast("int"), "text"))


_intent = " ".join(f"when list_has_any(w, {_list(ws)}) then '{n}'" for n, ws in ask.INTENTS)
ANALYSIS = f"""{A}, {E}, lw as (select ask_id, {W.format('lower(text)')} as w from asked), aw as (select distinct ask_id, word from (select ask_id, unnest(w) as word from lw) z),
 hit as (select ask_id, word, id from aw, entities e where contains(lower(e.name), word) or contains(word, lower(e.name))), ne as (select ask_id, count(distinct id) as n_entities from hit group by 1),
 nc as (select ask_id, count(*) as n_concepts from (select ask_id, unnest(w) as word from lw) z where strlen(word) > 3 and word not in ({_list(ask.STOP)[1:-1]}) and not exists (select 1 from hit h where h.ask_id = z.ask_id and h.word = z.word) group by 1),
 an as (select lw.ask_id, coalesce(n_entities, 0) as n_entities, coalesce(n_concepts, 0) as n_concepts, case when n_entities > 1 then 'Relationship' when n_entities = 1 then 'EntityFocused' when list_has_any(w, {_list(ask.ABSTRACT)}) then 'Conceptual' when list_has_any(w, {_list(ask.QUESTION)}) then 'Exploratory' else 'Factual' end as query_type,
 case {_intent} else 'Detailed' end as intent, round(least(cast(1 as double), 0.1 * len(w) + 0.3 * coalesce(n_entities, 0) + 0.2 * coalesce(n_concepts, 0)), 6) as complexity from lw left join ne using (ask_id) left join nc using (ask_id))"""


@query(f"with {ANALYSIS} select * from an")
def analyze_query(t):
    return ask.analyze(fx.asked(t), fx.entities(t))


def _table(kind: str, table: dict, names: list[str]) -> str:
    return ", ".join("case " + " ".join(f"when {kind} = '{k}' then cast({w[i]} as double)" for k, w in table.items()) + f" end as {n}" for i, n in enumerate(names))


@query(f"with {ANALYSIS}, k as (select ask_id, case when query_type in ('Conceptual', 'Exploratory') and intent = 'Overview' then query_type || '/Overview' else query_type end as k from an) select ask_id, {_table('k', ask.STRATEGIES, ['vector', 'graph', 'hierarchy'])} from k")
def strategy_weights(t):
    return ask.strategy_weights(ask.analyze(fx.asked(t), fx.entities(t)))


@query(f"with {ANALYSIS}, k as (select ask_id, case when complexity < 0.6 then 'Exploratory' else query_type end as k from an) select ask_id, {_table('k', ask.ADAPTIVE, ['vector', 'graph', 'hierarchy', 'lexical'])} from k")
def adaptive_weights(t):
    """The analysis' complexity stands for its confidence."""
    return ask.adaptive_weights(ask.analyze(fx.asked(t), fx.entities(t)), "complexity")


_marks = "(len(lo) - len(replace(lo, '\"', ''))) // 2 + (len(lo) - len(replace(lo, ' and ', ''))) // 5 + (len(lo) - len(replace(lo, 'between', ''))) // 7"


@query(f"""with {TEXTS}, x as (select ask_id, lower(text) as lo, len({W.format('text')}) as n, {_count('lower(text)', ask.BROAD)} as b, {_count('lower(text)', ask.NARROW)} as s from texts), y as (select ask_id, round(0.5 * case when b + s > 0 then (b - s) / cast(b + s as double) else 0 end
 + 0.3 * case when n between 1 and 3 then cast(0.5 as double) when n between 4 and 5 then 0.2 when n between 6 and 7 then 0 when n between 8 and 10 then -0.3 else -0.5 end + 0.2 * case {_marks} when 0 then cast(0.3 as double) when 1 then 0 when 2 then -0.4 else -0.7 end, 6) as score from x),
 z as (select *, case when score >= 0.7 then 'VeryBroad' when score >= 0.4 then 'Broad' when score >= -0.2 then 'Medium' when score >= -0.5 then 'Specific' else 'VerySpecific' end as breadth from y) select *, case breadth when 'VeryBroad' then 3 when 'Broad' then 2 when 'Medium' then 1 else 0 end as level from z""")
def query_complexity(t):
    return ask.breadth(texts(t))


@query(f"with {TEXTS} select ask_id, {_has('lower(text)', ask.CONCEPTUAL)} as conceptual from texts")
def is_conceptual_query(t):
    return texts(t).select("ask_id", ask.has(F.lower("text"), ask.CONCEPTUAL).alias("conceptual"))


_kind = "case " + " ".join(f"when {_has('lo', inside)}{''.join(f' or starts_with(lo, {_lit(b)})' for b in begins)} then '{n}'" for n, inside, begins in ask.KINDS) + " else 'General' end"
_turned = "case " + " ".join(f"when kind = '{k}' and contains(lo, '{p}') then replace(lo, '{p}', '{new}')" for k, p, new in ask.TEMPLATES) + " else lo end"
_syn = "case w " + " ".join(f"when '{k}' then {_list(v)}" for k, v in ask.SYNONYMS.items()) + " else cast([] as varchar[]) end"


@query(f"""with recursive {TEXTS}, k as (select ask_id, trim(lower(text)) as lo, {_kind.replace('lo,', 'trim(lower(text)),')} as kind from texts), u as (select ask_id, kind, lo, {W.format(_turned)} as ws from k),
 g as (select ask_id, 0 as i, cast([] as varchar[]) as done from u union all select g.ask_id, i + 1, list_concat(list_concat(done, [u.ws[i + 1]]), list_filter({_syn.replace('case w', 'case u.ws[i + 1]')}, x -> not list_contains(list_concat(done, [u.ws[i + 1]]), x))) from g join u on u.ask_id = g.ask_id where i < len(u.ws)),
 f as (select u.ask_id, kind, lo, done, len(list_filter(done, x -> x not in ({_list(ask.TERM_STOP)[1:-1]}))) as n from u join g on g.ask_id = u.ask_id and g.i = len(u.ws))
 select ask_id, kind, array_to_string(done, ' ') as rewritten, n as n_terms, round(case when n = 0 then 0.5 else 0.6 * least(cast(1 as double), n / cast(len({W.format('lo')}) + 1 as double)) + 0.4 * 0.5 end, 6) as confidence from f""")
def rewrite_query(t):
    return ask.rewrite(texts(t))


@query("""with recursive v as (select user_id, event_id, value / 100 as s, row_number() over (partition by user_id order by event_id) as rn from events where value is not null),
 r as (select user_id, cast(0 as bigint) as rn, cast(0.5 as double) as r from (select distinct user_id from v) z union all select v.user_id, v.rn, r.r * 0.5 + v.s * 0.5 from r join v on v.user_id = r.user_id and v.rn = r.rn + 1)
 select user_id, round(arg_max(r, rn), 6) as relevance from r group by 1""")
def relevance_feedback(t):
    return ask.feedback(t.events.where("value is not null").select("user_id", "event_id", (F.col("value") / 100).alias("s")), "user_id", "event_id", "s")


def _class_sql(n, ws, ps) -> str:
    return f"{{'o': round(least(cast(1 as double), 0.5 * {_count('lower(text)', ws)} / cast({len(ws)} as double) + 0.5 * ({' + '.join(f'cast(regexp_matches(lower(text), {_lit(p)}) as integer)' for p in ps)}) / cast({len(ps)} as double)), 6), 'intent': '{n}'}}"


@query(f"""with {TEXTS}, c as (select ask_id, regexp_matches(lower(text), '{ask.INAPPROPRIATE}') as bad, list_filter([{', '.join(_class_sql(*c) for c in ask.CLASSES)}], x -> x.o > 0) as s from texts),
 r as (select ask_id, bad, s, list_max(list_transform(s, x -> x.o)) as best, len(s) as n from c), q as (select *, (select min(u.intent) from (select unnest(r.s) as u) z where u.o = r.best) as top, n = 0 or len(list_filter(s, x -> x.o > 0.8 * best)) > 1 as vague from r)
 select ask_id, case when bad then 'Inappropriate' when vague then 'Ambiguous' else top end as intent, case when bad then 1 else coalesce(best, cast(0 as double)) end as confidence, bad or vague or coalesce(best < 0.3, true) as refuse from q""")
def classify_intent(t):
    return ask.classify(texts(t))


@query(f"""with {TEXTS}, x as (select ask_id, text, len({W.format('text')}) as n from texts) select ask_id, round(least(cast(1 as double), 0.3 * least(n / cast(20 as double), 1) + 0.2 * least(greatest(1, len(regexp_replace(text, '[^.?!]', '', 'g'))) / cast(3 as double), 1)
 + 0.2 * least(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / cast(greatest(n, 1) as double) / 8, 1) + case when {_has('text', [' and ', ' or ', ' but ', ' because ', ' since ', ' although '])} then cast(0.3 as double) else 0 end), 6) as complexity from x""")
def intent_complexity(t):
    return texts(t).select("ask_id", ask.complexity(F.col("text")).alias("complexity"))


_sep = "|".join(ask.SEPARATORS)
_clause_kind = "case when starts_with(lower(clause), 'who') then 'Entity' when starts_with(lower(clause), 'what person') then 'Entity' when starts_with(lower(clause), 'what') then 'Definitional' when starts_with(lower(clause), 'when') then 'Temporal' when starts_with(lower(clause), 'why') or contains(lower(clause), 'because') then 'Causal' when contains(lower(clause), 'relation') or contains(lower(clause), 'connect') then 'Relationship' when contains(lower(clause), 'compare') or contains(lower(clause), 'versus') then 'Comparative' else 'Attribute' end"
CLAUSES = f"""{TEXTS}, c0 as (select ask_id, text, list_filter(list_transform(string_split(regexp_replace(text, '(?i)(\\b(?:{_sep})\\b|[,;])', chr(1) || '\\1', 'g'), chr(1)), x -> trim(regexp_replace(trim(x), '(?i)^(?:(?:{_sep})\\b|[,;])', ''))), x -> strlen(x) > 3) as c from texts),
 c1 as (select ask_id, case when len(c) > 1 then c else [text] end as c from c0), cl as (select ask_id, unnest(range(len(c))) as place, unnest(c) as clause from c1), clause as (select *, {_clause_kind} as kind from cl)"""


@query(f"with {CLAUSES} select ask_id, place, clause, kind, round(1 - place / cast(10 as double), 6) as priority from clause")
def decompose_syntactic(t):
    return ask.clauses(texts(t))


_conj = " ".join(f"when regexp_matches(text, '\\b{w}\\b') then string_split_regex(text, '\\b{w}\\b')" for w in ("and", "or", "but", "also", "furthermore"))


@query(f"""with {TEXTS}, h as (select ask_id, text, regexp_matches(text, '\\b(who|what) is (.+?) and (.+)') as two, regexp_matches(text, '\\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)') as rel, case {_conj} else [text] end as loose from texts),
 p as (select ask_id, case when two then [regexp_extract(text, '\\b(who|what) is (.+?) and (.+)', 1) || ' is ' || regexp_extract(text, '\\b(who|what) is (.+?) and (.+)', 2), regexp_extract(text, '\\b(who|what) is (.+?) and (.+)', 3)]
 when rel then ['What is ' || regexp_extract(text, '\\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)', 1), 'What is ' || regexp_extract(text, '\\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)', 2), 'How are ' || regexp_extract(text, '\\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)', 1) || ' and ' || regexp_extract(text, '\\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)', 2) || ' related']
 else loose end as parts, case when two or rel then 'semantic' when len(loose) > 1 then 'conjunction' else 'single' end as strategy from h), q as (select ask_id, list_filter(list_transform(parts, x -> trim(x)), x -> x <> '') as parts, strategy from p)
 select ask_id, unnest(range(len(parts))) as place, unnest(parts) as part, strategy from q""")
def decompose_semantic(t):
    return ask.decompose(texts(t))


@query(f"""with {CLAUSES}, p as (select a.ask_id, a.place as later, b.place as earlier, a.kind as lk, b.kind as ek, min(case when b.kind = 'Entity' then b.place end) over (partition by a.ask_id, a.place) as first from clause a join clause b on a.ask_id = b.ask_id and b.place < a.place),
 d as (select ask_id, later, earlier, case when lk in ('Relationship', 'Attribute') and ek in ('Entity', 'Definitional') then 'Reference' when lk = 'Comparative' and ek in ('Entity', 'Definitional', 'Attribute') then 'Reference' when lk = 'Temporal' and earlier = first then 'Context' when lk = 'Causal' and earlier = later - 1 and ek in ('Entity', 'Temporal', 'Relationship') then 'Sequential' end as kind from p)
 select * from d where kind is not null""")
def subquery_dependencies(t):
    return ask.dependencies(ask.clauses(texts(t)))


_form = " ".join(f"when regexp_matches(text, {_lit(p)}) then {{'predicate': '{n}', 'x': trim(regexp_extract(text, {_lit(p)}, 1)), 'y': {f'trim(regexp_extract(text, {_lit(p)}, 2))' if k == 2 else 'cast(null as varchar)'}}}" for n, p, k in ask.FORMS)
FORMS = f"{A}, ff as (select ask_id, case {_form} end as f from asked), form as (select ask_id, f.predicate as predicate, f.x as x, f.y as y from ff where f is not null)"
NAMED = f"{FORMS}, {E}, {R}, nx as (select ask_id, predicate, e.* from form, entities e where x <> '' and contains(lower(e.name), lower(x))), ny as (select ask_id, predicate, e.* from form, entities e where y <> '' and contains(lower(e.name), lower(y)))"


@query(f"with {FORMS} select * from form")
def parse_logic_form(t):
    return ask.logic_forms(fx.asked(t))


@query(f"with {NAMED} select ask_id, id, name, entity_type from nx where predicate = 'Is'")
def logic_is(t):
    return ask.logic_is(ask.logic_forms(fx.asked(t)), fx.entities(t))


@query(f"""with {NAMED} select distinct a.ask_id, r.source, r.target, r.relation_type from nx a join ny b on a.ask_id = b.ask_id and a.predicate = 'Related' join relationships r on (r.source = a.id and r.target = b.id) or (r.source = b.id and r.target = a.id)""")
def logic_related(t):
    return ask.logic_related(ask.logic_forms(fx.asked(t)), fx.entities(t), fx.relationships(t))


@query(f"""with {NAMED}, tx as (select ask_id, string_agg(distinct entity_type, ',' order by entity_type) as x_types from nx where predicate = 'Compare' group by 1), ty as (select ask_id, string_agg(distinct entity_type, ',' order by entity_type) as y_types from ny where predicate = 'Compare' group by 1) select ask_id, x_types, y_types, x_types = y_types as same from tx join ty using (ask_id)""")
def logic_compare(t):
    return ask.logic_compare(ask.logic_forms(fx.asked(t)), fx.entities(t))


_wn, _wa = W.format("lower(e.name)"), W.format("lower(x)")
FUZZY = f"""{FORMS}, {E}, fz as (select ask_id, id, lower(e.name) = lower(x) as exact, contains(lower(x), lower(e.entity_type)) as typed, list_has_any({_wn}, {_wa}) as near, 0.4 * len(list_intersect(list_distinct({_wn}), list_distinct({_wa}))) / cast(len(list_distinct(list_concat({_wn}, {_wa}))) as double)
 + 0.4 * len(list_intersect(list_distinct({_wn}), list_distinct({_wa}))) / cast(least(len(list_distinct({_wn})), len(list_distinct({_wa}))) as double) + 0.2 * (1 - levenshtein(lower(e.name), lower(x)) / cast(greatest(length(e.name), length(x)) as double)) as s from form, entities e),
 fh as (select *, case when exact then 'exact' when s >= 0.6 then 'partial' when typed then 'type' end as how from fz where exact or typed or near), fs as (select ask_id, id, round(case how when 'exact' then 1 when 'partial' then 0.9 * s else 0.7 end, 6) as score, how from fh where how is not null),
 fm as (select * from (select *, row_number() over (partition by ask_id order by score desc, id) as rank from fs) z where rank <= 10)"""


@query(f"with {FUZZY} select * from fm")
def fuzzy_match(t):
    return ask.fuzzy(ask.logic_forms(fx.asked(t)), fx.entities(t))


@query(f"with {FUZZY}, w as (select *, case how when 'exact' then cast(1 as double) when 'partial' then 0.8 else 0.5 end / rank as w from fm) select ask_id, round(sum(score * w) / sum(w), 6) as confidence, case when bool_or(how = 'exact') then 'ExactMatch' when bool_or(how = 'partial') then 'PartialMatch' else 'TypeMatch' end as strategy from w group by 1")
def match_confidence(t):
    return ask.match_confidence(ask.fuzzy(ask.logic_forms(fx.asked(t)), fx.entities(t)))


SPOKEN = "sp as (select conv_id, turn, text, cast(0.3 as double) + ((conv_id * 7 + turn * 3) % 70) / cast(100 as double) as c from conversations where role = 'assistant')"


@query(f"""with {SPOKEN}, once as (select conv_id, text, min(turn) as turn from sp group by 1, 2), s as (select *, row_number() over (partition by conv_id order by c desc, turn, text) as rn from sp)
 select conv_id, 'sequential' as way, md5(string_agg(text, chr(10) order by turn, text)) as content_md5, round(avg(c), 6) as confidence from sp group by 1 union all select conv_id, 'weighted', md5(string_agg(text, chr(10) order by rn)), round(sqrt(avg(c * c)), 6) from s group by 1
 union all select conv_id, 'best_only', md5(text), round(c, 6) from s where rn = 1 union all select conv_id, 'smart_merge', md5(string_agg(text, ' ' order by turn, text)), (select round(avg(c), 6) from sp where sp.conv_id = once.conv_id) from once group by 1
 union all select conv_id, 'hierarchical', md5(any_value(text) filter (rn = 1) || chr(10) || chr(10) || coalesce(string_agg(text, chr(10) order by rn) filter (rn > 1), '')), round(max(c) filter (rn = 1), 6) from s group by 1""")
def synthesize(t):
    c = t.conversations.where("role = 'assistant'").select("conv_id", "turn", "text", (F.lit(0.3) + ((F.col("conv_id") * 7 + F.col("turn") * 3) % 70) / F.lit(100.0)).alias("confidence"))
    return ask.synthesize(c, "conv_id", "turn")
