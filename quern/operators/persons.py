"""Persons' names: ordered rules over a text's words, each of which consumes the words it takes.

Names that are known come first, then titles with one or two words after them, then two likely words in a row, then
single ones. A rule goes from left to right and takes no word that an earlier rule or match has taken, so every word
is in one name at most. A text is one row and all rules are folds over its words in the JVM.

Laws: a null or empty text has no names; a name that stands several times is given as often; words are parted by white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import entities as en

# Names that are known, and words that are no person's name.
KNOWN = ["entity name"] + [f"{n} entity" for n in ("second", "guardian", "friend", "companion", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")]
NO_PERSON = [
    "chapter", "the", "and", "but", "or", "in", "on", "at", "to", "for", "with", "by", "from", "about", "into", "through", "during", "before", "after", "above", "below",
    "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now",
    "temptations", "strategic", "movements", "decides", "upon", "whitewashing", "saturday", "monday", "tuesday", "wednesday", "thursday", "friday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "adventures", "complete",
]
#: How sure a rule is of its names.
SURE = {"known": 0.95, "title": 0.9, "two": 0.8, "one": 0.6}


def tokens(text: Column) -> Column:
    """Of each word: its bare name, and whether it could be of a person (p), no person's (s) or a title (t)."""

    def told(word: Column) -> Column:
        name = F.when(word.rlike("[^a-z]"), en.bare(word)).otherwise(word)  # most words are bare already
        return tx.let(name, lambda name: told_of(word, name))

    def told_of(word: Column, name: Column) -> Column:
        return F.struct(name.alias("name"), (en.capital(word) & en.person_word(name)).alias("p"), F.lower(name).isin(NO_PERSON).alias("s"), F.lower(name).isin(en.TITLES).alias("t"))

    return F.transform(tx.words(text), told)


def taken(lengths: Column) -> Column:
    """Array of (place, length): matches from left to right, none inside another. lengths: words that a match at each place takes, 0 for none."""
    none = F.array().cast("array<struct<place:int,length:int>>")
    free = lambda out: F.when(F.size(out) == 0, 0).otherwise(F.get(out, F.size(out) - 1)["place"] + F.get(out, F.size(out) - 1)["length"])
    found = F.filter(F.transform(lengths, lambda n, i: F.struct(i.alias("place"), n.alias("length"))), lambda x: x["length"] > 0)
    return F.aggregate(found, none, lambda out, x: F.when(x["place"] >= free(out), F.array_append(out, x)).otherwise(out))


def without(words: Column, spans: Column) -> Column:
    """The words, null where a match has taken them."""
    return F.when(F.size(spans) == 0, words).otherwise(F.transform(words, lambda w, i: F.when(~F.exists(spans, lambda x: (i >= x["place"]) & (i < x["place"] + x["length"])), w)))


def applied(state: Column, rule: str, lengths, skip: int = 0) -> Column:
    """The state (w, found) after a rule; lengths(word, next, after next): how many words it takes; skip: words that aren't of the name."""

    def told(w: Column, x: Column) -> Column:
        name = F.array_join(F.transform(F.slice(w, x["place"] + 1 + skip, x["length"] - skip), lambda word: word["name"]), " ")
        return F.struct(x["place"].alias("place"), x["length"].alias("words"), name.alias("name"), F.lit(rule).alias("rule"))

    def after(found: Column, w: Column) -> Column:
        each = F.transform(w, lambda word, i: F.coalesce(lengths(word, F.get(w, i + 1), F.get(w, i + 2)), F.lit(0)))
        return tx.let(taken(each), lambda m: F.struct(without(w, m).alias("w"), F.concat(found, F.transform(m, lambda x: told(w, x))).alias("found")))

    return tx.let(state, lambda st: tx.let(st["w"], lambda w: after(st["found"], w)))


def found_in(words: Column) -> Column:
    """Array of (place, words, name, rule): what the rules take of tokens(), in their order."""
    pair = lambda a, b: F.lower(F.concat_ws(" ", a["name"], b["name"]))
    none = F.array().cast("array<struct<place:int,words:int,name:string,rule:string>>")
    state = F.struct(words.alias("w"), none.alias("found"))
    state = applied(state, "known", lambda a, b, c: F.when(a.isNotNull() & b.isNotNull() & pair(a, b).isin(KNOWN), 2))
    state = applied(state, "title", lambda a, b, c: F.when(a["t"] & b["p"], F.when(c["p"], 3).otherwise(2)), skip=1)
    state = applied(state, "two", lambda a, b, c: F.when(a["p"] & b["p"] & ~a["s"] & ~b["s"], 2))
    state = applied(state, "one", lambda a, b, c: F.when(a["p"] & ~a["s"], 1))
    return state["found"]


def name_of(x: Column) -> Column:
    return F.when(x["rule"] == "known", F.initcap(x["name"])).otherwise(x["name"])


def sure(x: Column) -> Column:
    return F.coalesce(*[F.when(x["rule"] == r, c) for r, c in SURE.items()])


def persons(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """(keys..., place, name, rule, confidence): place is that of the first word taken, a title's where there is one."""
    keys, x = [c for c in df.columns if c != text], F.col("x")
    each = df.where(F.col(text).isNotNull()).select(F.struct(*[F.col(c) for c in keys]).alias("keys"), F.explode(found_in(tokens(F.col(text)))).alias("x"))
    made = each.select(*[F.col(f"keys.{c}").alias(c) for c in keys], "x.place", name_of(x).alias("name"), "x.rule", sure(x).alias("confidence"))
    return made.where(F.col("confidence") >= least)


def extract(df: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """(keys..., name, entity_type, confidence): persons, concepts, events, objects, organisations and places of each text,
    each name and type once, at its best. A text is read and cut into words once, on its own row; nothing is shuffled."""
    keys, t = [c for c in df.columns if c != text], F.col(text)
    row = lambda name, kind, c: F.struct(name.alias("name"), F.lit(kind).alias("entity_type"), c.alias("confidence"))
    listed = lambda names, kind, c, whole: F.transform(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(whole, n)), lambda n: row(n, kind, c(n)))

    def concept(word: Column) -> Column:
        marked = en.any_of([F.contains(word["name"], F.lit(c)) for c in en.CONCEPTS])
        plain = en.capital(word["word"]) & (F.octet_length(word["word"]) > 4) & ~F.lower(word["name"]).isin(en.COMMON)
        return row(word["name"], "CONCEPT", F.when(marked, 0.75).when(plain, 0.6))

    words = F.transform(tx.words(t), lambda w: F.struct(w.alias("word"), en.bare(w).alias("name")))
    every = F.concat(
        F.transform(found_in(tokens(t)), lambda x: row(name_of(x), "PERSON", sure(x))), F.transform(words, concept), listed(en.EVENTS, "EVENT", lambda n: F.lit(0.7), F.lower(t)),
        listed(en.OBJECTS, "OBJECT", lambda n: F.lit(0.65), F.lower(t)), F.transform(en.organisation_names(t), lambda n: row(n, "ORGANIZATION", en.confidence(n, F.lit("ORGANIZATION")))),
        listed(en.LOCATIONS, "LOCATION", lambda n: en.confidence(n, F.lit("LOCATION")), t),
    )
    wanted = F.array_distinct(F.filter(every, lambda x: x["confidence"] >= least))
    best = tx.let(wanted, lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (y["name"] == x["name"]) & (y["entity_type"] == x["entity_type"]) & (y["confidence"] > x["confidence"]))))
    each = df.where(t.isNotNull()).select(F.struct(*[F.col(c) for c in keys]).alias("keys"), F.explode(best).alias("x"))
    return each.select(*[F.col(f"keys.{c}").alias(c) for c in keys], "x.name", "x.entity_type", "x.confidence")
