"""Entities by custom rules of all seven kinds over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ner
from quern.plans.registry import query

RULES = [
    ner.Rule("copyright", "exact", "NOTICE", "copyright", 7), ner.Rule("licence", "dictionary", "LICENCE", priority=6), ner.Rule("mail", "regex", "EMAIL", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+", 5),
    ner.Rule("of", "contextual", "PHRASE", "the|on|of", 4), ner.Rule("link", "prefix", "URL", "http", 3), ner.Rule("noun", "suffix", "NOUN", "tion", 2), ner.Rule("contact", "contains", "CONTACT", "@", 1),
]
DICTIONARY = {"LICENCE": ["licence", "license", "apache license", "permission", "warranty", "all rights reserved"]}
_entries = "[" + ", ".join(f"'{w}'" for w in DICTIONARY["LICENCE"]) + "]"
_found = lambda needle: f"unnest(list_transform(range(1, len(string_split(low, {needle}))), lambda k: cast(list_sum(list_transform(string_split(low, {needle})[1:k], lambda x: length(x))) as bigint) + (k - 1) * length({needle})))"
SPANS = f"""docs as (select doc_id, text, lower(text) as low from documents where text is not null), pieces as (select doc_id, unnest(regexp_extract_all(low, '[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+')) as w, unnest(range(len(regexp_extract_all(low, '[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+')))) as i from docs),
 placed as (select *, cast(sum(length(w)) over (partition by doc_id order by i) - length(w) as bigint) as a from pieces), words as (select *, lag(w) over v as before, lead(w) over v as after from placed where not regexp_full_match(w, '[ \\t\\n\\r\\f]+') window v as (partition by doc_id order by i)),
 mails as (select doc_id, text, unnest(regexp_extract_all(text, '{RULES[2].pattern}')) as m, unnest(regexp_split_to_array(text, '{RULES[2].pattern}')[1:len(regexp_extract_all(text, '{RULES[2].pattern}'))]) as gap, unnest(range(len(regexp_extract_all(text, '{RULES[2].pattern}')))) as i from docs),
 spans as (select doc_id, {_found("'copyright'")} as a, 9 as n, cast(1 as double) as c, 0 as o from docs
  union all select doc_id, {_found('entry')}, length(entry), 0.95, 1 from (select *, unnest({_entries}) as entry from docs) z
  union all select doc_id, cast(sum(length(gap) + length(m)) over (partition by doc_id order by i) - length(m) as bigint), length(m), 0.9, 2 from mails
  union all select doc_id, a, length(w), 0.85, 3 from words where contains(before, 'the') and contains(w, 'on') and contains(after, 'of')
  union all select doc_id, a, length(w), 0.7, 4 from words where starts_with(w, 'http') union all select doc_id, a, length(w), 0.7, 5 from words where ends_with(w, 'tion') union all select doc_id, a, length(w), 0.6, 6 from words where contains(w, '@')),
 arr as materialized (select doc_id, list({{'a': a, 'b': a + n, 'c': c, 'o': o}} order by a, c desc, o, n) as s from spans group by 1),
 r(doc_id, i, last, taken) as (select doc_id, 0, cast(0 as bigint), false from arr union all select r.doc_id, i + 1, case when s[i + 1].a >= last then s[i + 1].b else last end, s[i + 1].a >= last from r join arr on arr.doc_id = r.doc_id where i < len(s))"""
_of = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "][s[i].o + 1]"


@query(f"with recursive {SPANS} select r.doc_id, cast(s[i].a as integer) as start, cast(s[i].b as integer) as \"end\", {_of([r.entity_type for r in RULES])} as entity_type, s[i].c as confidence, {_of([r.name for r in RULES])} as rule from r join arr on arr.doc_id = r.doc_id where taken")
def ner_custom_rules(t):
    return ner.extract(t.documents, RULES, DICTIONARY).drop("text")


@query(f"with recursive {SPANS} select {_of([r.entity_type for r in RULES])} as entity_type, count(*) as mentions, count(distinct r.doc_id) as documents from r join arr on arr.doc_id = r.doc_id where taken group by 1")
def ner_custom_stats(t):
    return ner.extract(t.documents, RULES, DICTIONARY).groupBy("entity_type").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))
