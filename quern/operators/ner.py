"""Entities by a user's rules of seven kinds, and the choice among spans that overlap.

Kinds: exact (1.0), dictionary (.95), regex (.9), contextual (.85; "before|target|after", three words in a row that hold these),
prefix, suffix (.7) and contains (.6) of a word. All but regex disregard case. A text is read once: exact and dictionary
entries by one Aho-Corasick automaton, the others word by word. Overlaps are resolved by a fold in the JVM.

Laws: offsets are true ones, in characters; occurrences of one entry don't overlap each other; a null text has no entity; an empty
pattern matches nothing; rules of equal start and confidence stand by priority (the higher first), then in their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE = {"exact": 1.0, "dictionary": 0.95, "regex": 0.9, "contextual": 0.85, "prefix": 0.7, "suffix": 0.7, "contains": 0.6}
#: Characters of all dictionaries together: each task holds an automaton of them.
DICTIONARY = 32 << 20
SPAN = "struct<start:int,end:int,confidence:double,order:int>"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    entity_type: str
    pattern: str = ""
    priority: int = 0


class Matcher:
    """Spans (start, end, confidence, rule's number) of a text."""

    def __init__(self, rules: list[Rule], dictionaries: dict[str, list[str]]):
        self.rules, self.automaton, entries = rules, ahocorasick.Automaton(), {}
        for i, r in enumerate(rules):
            words = [r.pattern] if r.kind == "exact" else dictionaries.get(r.entity_type, []) if r.kind == "dictionary" else []
            for w in dict.fromkeys(x.lower() for x in words if x):
                entries.setdefault(w, []).append(i)
        for w, owners in entries.items():
            self.automaton.add_word(w, (w, owners))
        if entries:
            self.automaton.make_automaton()
        self.entries = bool(entries)
        self.patterns = [(i, re.compile(r.pattern)) for i, r in enumerate(rules) if r.kind == "regex" and r.pattern]
        self.by_word = [(i, r.kind, r.pattern.lower()) for i, r in enumerate(rules) if r.kind in ("prefix", "suffix", "contains") and r.pattern]
        self.contexts = [(i, [p.lower() for p in r.pattern.split("|")]) for i, r in enumerate(rules) if r.kind == "contextual" and r.pattern.count("|") == 2]

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # letters whose small form is longer keep their own form
            low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
        last: dict[str, int] = {}
        for at, (w, owners) in self.automaton.iter(low) if self.entries else ():
            start = at + 1 - len(w)
            if start >= last.get(w, 0):
                last[w] = at + 1
                yield from ((start, at + 1, i) for i in owners)
        for i, pattern in self.patterns:
            yield from ((m.start(), m.end(), i) for m in pattern.finditer(text) if m.end() > m.start())
        if not self.by_word and not self.contexts:
            return
        words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\f]+", low)]
        for a, b in words:
            w = low[a:b]
            for i, kind, p in self.by_word:
                if w.startswith(p) if kind == "prefix" else w.endswith(p) if kind == "suffix" else p in w:
                    yield a, b, i
        for (a, b), (c, d), (e, f) in zip(words, words[1:], words[2:]) if self.contexts else ():
            for i, (before, target, after) in self.contexts:
                if before in low[a:b] and target in low[c:d] and after in low[e:f]:
                    yield c, d, i


def resolved(spans: Column) -> Column:
    """Of an array of spans those that overlap no earlier one taken: by start, then the surer, then the rule's order."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["confidence"]).alias("unsure"), x["order"].alias("order"), x["end"].alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (-x["unsure"]).alias("confidence"), x["order"].alias("order")))
    none = F.array().cast(f"array<{SPAN}>")
    last = lambda out: F.coalesce(F.get(out, F.size(out) - 1)["end"], F.lit(0))
    return F.aggregate(ordered, none, lambda out, x: F.when(x["start"] >= last(out), F.array_append(out, x)).otherwise(out))


def extract(df: DataFrame, rules: list[Rule], dictionaries: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, text, entity_type, confidence, rule): what the rules find, without overlaps."""
    wrong = sorted({r.kind for r in rules} - set(SURE))
    if wrong:
        raise ValueError(f"no kinds of rules: {', '.join(wrong)}")
    dictionaries = dictionaries or {}
    if sum(len(w) for ws in dictionaries.values() for w in ws) > DICTIONARY:
        raise ValueError(f"dictionaries of more than {DICTIONARY} characters; give them in parts")
    rules = sorted(rules, key=lambda r: -r.priority)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, dictionaries)
        for batch in batches:
            found = [[{"start": a, "end": b, "confidence": SURE[rules[i].kind], "order": i} for a, b, i in matcher.spans(t)] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("order", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["key", "text", "spans"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    each = rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string, spans array<{SPAN}>").select("key", "text", F.explode(resolved(F.col("spans"))).alias("x"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("x.order"))
    return each.select(F.col("key").alias(key), "x.start", "x.end", F.substring("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("text"), of([r.entity_type for r in rules]).alias("entity_type"), "x.confidence", of([r.name for r in rules]).alias("rule"))
