"""Entities of texts by rules, and what follows from them: ids, mentions, types, relations.

Texts come as rows of (keys..., text); all rules are column expressions, so nothing leaves the JVM. Pairs of
names are made within a chunk, whose size is bounded, never within a document or a corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

# Words that name no entity.
COMMON = [
    "the", "and", "but", "or", "in", "on", "at", "to", "for", "with", "by", "from", "about", "into", "through", "during", "before", "after", "above", "below",
    "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now",
    "could", "would", "said", "says", "told", "asked", "went", "came", "come", "going", "chapter", "page", "section", "part", "book", "volume",
]
# Endings and beginnings of persons' names, and short words that are none.
NAME_ENDS = ["son", "sen", "ton", "ham", "ford", "ley", "ment", "ard", "ert"]
NAME_BEGINS = ["mc", "mac", "o'", "de", "van", "von", "la", "le"]
SHORT = ["it", "is", "as", "at", "be", "by", "do", "go", "he", "if", "in", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we"]
TITLES = ["mr", "mrs", "ms", "dr", "prof", "professor", "sir", "lady", "lord", "captain", "major", "colonel", "general", "admiral", "judge", "father", "mother", "brother", "sister", "aunt", "uncle", "grandfather", "grandmother"]
# Words that tell a concept, an event, an object; places; marks of organisations.
CONCEPTS = ["Theory", "Concept", "Principle", "Philosophy", "Doctrine", "Idea", "Method", "Approach", "Framework", "Model", "Paradigm", "Thesis"]
EVENTS = ["meeting", "conference", "ceremony", "celebration", "festival", "competition", "war", "battle", "expedition", "journey", "trial"]
OBJECTS = ["sword", "shield", "book", "manuscript", "scroll", "tablet", "ring", "crown", "treasure", "coin", "tool", "weapon"]
LOCATIONS = ["United States", "New York", "California", "London", "Paris", "Tokyo", "Berlin", "Washington", "Boston", "Chicago"]
ORGANISATION_ENDS = ["Inc", "Corp", "LLC", "Ltd", "Company", "Corporation", "Group", "Solutions", "Technologies"]
ORGANISATION_MARKS = ["Inc", "Corp", "LLC", "Ltd", "Company", "Corporation", "University", "Institute"]
ORGANISATION_BEGINS = ["University of", "Institute of", "Department of"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def bare(word: Column) -> Column:
    """Letters and inner apostrophes of a word."""
    return F.regexp_replace(F.regexp_replace(word, r"[^\p{L}']", ""), "'+$", "")


def capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def words_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., place, word, name): each word with its bare form."""
    keys = [c for c in df.columns if c != text]
    each = df.select(*keys, F.posexplode(tx.words(F.col(text))).alias("place", "word"))
    return each.withColumn("name", bare(F.col("word")))


def person_word(name: Column) -> Column:
    """Whether a bare word could be part of a person's name."""
    low, size = F.lower(name), F.octet_length(name)
    known = any_of([low.endswith(e) for e in NAME_ENDS] + [low.startswith(b) for b in NAME_BEGINS])
    return (size >= 2) & ~((size <= 2) & low.isin(SHORT)) & name.rlike(r"^\p{Lu}[\p{L}']*$") & ((size >= 3) | known)


def generic(df: DataFrame, text: str = "text", least: int = 3, confidence: float = 0.5) -> DataFrame:
    """(keys..., name, confidence): capitalised words of more than `least` bytes that aren't common, each once."""
    keys = [c for c in df.columns if c != text]
    w = words_of(df, text).where(capital(F.col("word")) & (F.octet_length("word") > least) & ~F.lower("name").isin(COMMON))
    return w.select(*keys, "name").distinct().withColumn("confidence", F.lit(confidence))


def concepts(df: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., name, confidence): words with a mark of a concept .75, other capitalised words over four bytes .6."""
    keys = [c for c in df.columns if c != text]
    marked = any_of([F.contains(F.col("name"), F.lit(c)) for c in CONCEPTS])
    plain = capital(F.col("word")) & (F.octet_length("word") > 4) & ~F.lower("name").isin(COMMON)
    w = words_of(df, text).withColumn("confidence", F.when(marked, 0.75).when(plain, 0.6)).where("confidence is not null")
    return w.groupBy(*keys, "name").agg(F.max("confidence").alias("confidence"))


def dictionary(df: DataFrame, names: list[str], confidence: float, text: str = "text", any_case: bool = True) -> DataFrame:
    """(keys..., name, confidence): names that a text has as substrings."""
    keys = [c for c in df.columns if c != text]
    whole = F.lower(text) if any_case else F.col(text)
    found = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(whole, n))
    return df.select(*keys, F.explode(found).alias("name")).withColumn("confidence", F.lit(confidence))


def organisation_names(t: Column) -> Column:
    """Array of names: the word up to the first of each ending, if it has a mark; from a beginning to the sentence's end."""
    found = []
    for end in ORGANISATION_ENDS:
        at = F.instr(t, end)
        head = F.substring(t, F.lit(1), at - 1)
        found.append(F.when(at > 0, F.trim(F.concat(F.substring_index(head, " ", -1), F.lit(end)))))
    marked = F.filter(F.array(*found), lambda n: n.isNotNull() & any_of([F.contains(n, F.lit(m)) for m in ORGANISATION_MARKS]))
    begun = []
    for begin in ORGANISATION_BEGINS:
        rest = F.substring(t, F.instr(t, begin), F.length(t))
        name = F.trim(F.when(F.contains(rest, F.lit(".")), F.substring_index(rest, ".", 1)).otherwise(F.substring(rest, 1, 50)))
        begun.append(F.when((F.instr(t, begin) > 0) & (F.length(name) > len(begin)), name))
    return F.array_distinct(F.concat(marked, F.filter(F.array(*begun), lambda n: n.isNotNull())))


def organisations(df: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., name) of organisation_names()."""
    return df.select(*[c for c in df.columns if c != text], F.explode(organisation_names(F.col(text))).alias("name"))


def confidence(name: Column, kind: Column) -> Column:
    """How sure a name is of its type: half, and what its form adds, at most 1."""
    has = lambda *marks: any_of([F.contains(name, F.lit(m)) for m in marks])
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    person = add(has("Dr.", "Prof."), 0.3) + add(F.size(tx.words(name)) == 2, 0.2)
    organisation = add(has("Inc", "Corp", "LLC"), 0.3) + add(has("University", "Institute"), 0.2)
    place = add(has(","), 0.2) + add(name.isin(LOCATIONS), 0.3)
    own = F.when(kind == "PERSON", person).when(kind == "ORGANIZATION", organisation).when(kind == "LOCATION", place).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + own + add(capital(name), 0.1))


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat_ws("_", kind, F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", ""))


def mentions(names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """(keys..., name, start, end): non-overlapping occurrences of each row's name in its text, in characters."""
    keys = [c for c in names.columns if c not in (text, name)]
    own = names.select(F.struct(*[F.col(c) for c in keys]).alias("keys"), F.col(name).alias("own"), F.col(text).alias("whole")).where((F.length("own") > 0) & F.contains("whole", F.col("own")))
    quoted = F.concat(F.lit("\\Q"), F.replace("own", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    each = own.select("keys", "own", F.posexplode(F.transform(F.split("whole", quoted, -1), F.length)).alias("k", "n"))
    w = Window.partitionBy("keys", "own").orderBy("k")
    at = each.withColumn("start", F.sum("n").over(w) + F.col("k") * F.length("own")).withColumn("last", F.max("k").over(Window.partitionBy("keys", "own")))
    return at.where("k < last").select(*[F.col(f"keys.{c}").alias(c) for c in keys], F.col("own").alias(name), "start", (F.col("start") + F.length("own")).alias("end"))


def pattern_filter(entities: DataFrame, allowed: list[str], excluded: list[str], name: str = "name") -> DataFrame:
    """Entities whose name matches any allowed pattern (if there are any) and no excluded one."""
    test = lambda ps: any_of([F.col(name).rlike(p) for p in ps])
    out = entities.where(test(allowed)) if allowed else entities
    return out.where(~test(excluded)) if excluded else out


def dedupe(entities: DataFrame, any_case: bool = False) -> DataFrame:
    """(name, entity_type, rows, confidence): one row for each name and type, or with any_case for each id of theirs."""
    if any_case:
        return entities.groupBy(F.concat_ws("_", F.col("entity_type"), F.lower("name")).alias("id")).agg(F.min("name").alias("name"), F.count("*").alias("rows"), F.max("confidence").alias("confidence"))
    return entities.groupBy("name", "entity_type").agg(F.count("*").alias("rows"), F.max("confidence").alias("confidence"))


def type_of_fact(name: Column) -> Column:
    """Type of a subject or object of a fact: places by ending, other capitalised names persons, dates by digits."""
    low = F.lower(name)
    place = low.endswith("ia") | low.endswith("land") | low.endswith("istan")
    return F.when(capital(name), F.when(place, "LOCATION").otherwise("PERSON")).when(name.rlike("[0-9]"), "DATE").otherwise("CONCEPT")


def type_in_corpus(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *marks: any_of([F.contains(low, F.lit(m)) for m in marks])
    return F.when(has("company", "corp", "inc"), "organization").when(capital(name) & ~F.contains(name, F.lit(" ")), "person").when(has("city", "country"), "location").otherwise("other")


def type_by_guess(name: Column, kinds: tuple[str, ...] = ("person", "organization", "location", "concept")) -> Column:
    """A type that the name holds, else by ending and marks; short single words are persons."""
    low = F.lower(name)
    out = F.lit("other")
    out = F.when((F.size(tx.words(name)) == 1) & (F.octet_length(name) < 20), "person").otherwise(out)
    out = F.when(any_of([F.contains(low, F.lit(m)) for m in ("city", "country", "state")]), "location").otherwise(out)
    out = F.when(any_of([low.endswith(m) for m in ("company", "corp", "inc")]), "organization").otherwise(out)
    for kind in reversed(kinds):
        out = F.when(F.contains(low, F.lit(kind)), kind).otherwise(out)
    return out


def indexed(df: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., name, entity_type, confidence): three capitalised words .6, single ones over two bytes .5; a name once."""
    keys = [c for c in df.columns if c != text]
    w = df.select(*keys, tx.words(F.col(text)).alias("w"))
    at = lambda i: F.col("w")[F.col("i") + i]
    three = w.where("size(w) >= 3").select(*keys, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i"))
    three = three.where(capital(at(0)) & capital(at(1)) & capital(at(2))).select(*keys, F.concat_ws(" ", at(0), at(1), at(2)).alias("name"), F.lit(0.6).alias("confidence"))
    one = w.select(*keys, F.explode("w").alias("name")).where(capital(F.col("name")) & (F.octet_length("name") > 2)).withColumn("confidence", F.lit(0.5))
    return three.union(one).groupBy(*keys, "name").agg(F.max("confidence").alias("confidence")).withColumn("entity_type", type_by_guess(F.col("name")))


# Phrases between two names, the relation that each tells, and how surely; the first that occurs counts.
PHRASES = [
    ("works at", "works_at", 0.7), ("works for", "works_at", 0.7), ("employed by", "works_at", 0.7), ("employee of", "works_at", 0.7), ("works as", "works_as", 0.6),
    ("located in", "located_in", 0.8), ("based in", "located_in", 0.7), ("in", "located_in", 0.4), ("from", "from", 0.5), ("founded", "founded", 0.8), ("created", "created", 0.7),
    ("manages", "manages", 0.8), ("leads", "leads", 0.7), ("owns", "owns", 0.8), ("part of", "part_of", 0.7), ("subsidiary of", "subsidiary_of", 0.8),
    ("collaborates with", "collaborates_with", 0.7), ("partners with", "partners_with", 0.7), ("associated with", "associated_with", 0.6), ("related to", "related_to", 0.5), ("knows", "knows", 0.6),
]


def pairs_of(found: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Each two names of a chunk, the lesser as name, the other as other, with their other columns (other: prefixed)."""
    rest = [c for c in found.columns if c not in keys]
    right = found.select(*keys, *[F.col(c).alias("other" if c == name else f"other_{c}") for c in rest])
    return found.join(right, keys).where(F.col(name) < F.col("other"))


def placed_pairs(df: DataFrame, found: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pairs of names with their first places a and b in the lower-case text (low) of their chunk."""
    low = df.select(*keys, F.lower(text).alias("low"))
    at = found.select(*keys, "name", "entity_type").join(low, keys).withColumn("at_", F.instr("low", F.lower("name"))).where("at_ > 0")
    pairs = pairs_of(at.drop("low"), keys).withColumnsRenamed({"at_": "a", "other_at_": "b"})
    return pairs.join(low, keys)


def phrase_relations(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., source, target, relation_type, confidence) by the phrase between the first places of two names."""
    keys = [c for c in df.columns if c != text]
    p = placed_pairs(df, found, keys, text).withColumn("between", F.substring("low", F.least("a", "b"), F.abs(F.col("a") - F.col("b"))))
    forward, between = F.col("a") < F.col("b"), F.col("between")
    first, second = F.when(forward, F.col("entity_type")).otherwise(F.col("other_entity_type")), F.when(forward, F.col("other_entity_type")).otherwise(F.col("entity_type"))
    hit = F.lit(None).cast("struct<relation:string,confidence:double>")
    for phrase, relation, base in reversed(PHRASES):
        hit = F.when(F.contains(between, F.lit(phrase)), F.struct(F.lit(relation).alias("relation"), F.lit(base).alias("confidence"))).otherwise(hit)
    p = p.withColumn("hit", hit).withColumn("first", first).withColumn("second", second).where("hit is not null")
    kind = F.col("hit.relation")
    more = F.when(kind.isin("works_at", "founded") & (F.col("first") == "person") & (F.col("second") == "organization"), 0.2).when((kind == "located_in") & (F.col("second") == "location"), 0.2).when((kind == "manages") & (F.col("first") == "person"), 0.1).otherwise(0.0)
    turned = ~forward & ~kind.isin("works_at", "located_in", "from")  # in the reverse order these three keep name as source
    source, target = F.when(turned, F.col("other")).otherwise(F.col("name")), F.when(turned, F.col("name")).otherwise(F.col("other"))
    return p.select(*keys, source.alias("source"), target.alias("target"), kind.alias("relation_type"), F.round(F.least(F.lit(1.0), F.col("hit.confidence") + more), 6).alias("confidence")).distinct()


def relation_by_types(a: Column, b: Column, context: Column) -> Column:
    """The relation of two entities from their types and what their context says."""
    says = lambda *marks: any_of([F.contains(context, F.lit(m)) for m in marks])
    both = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (
        F.when(both("PERSON", "ORGANIZATION"), F.when(says("works for", "employed by"), "WORKS_FOR").when(says("founded", "CEO"), "LEADS").otherwise("ASSOCIATED_WITH"))
        .when(both("PERSON", "LOCATION"), F.when(says("born in", "from"), "BORN_IN").when(says("lives in", "based in"), "LOCATED_IN").otherwise("ASSOCIATED_WITH"))
        .when(both("ORGANIZATION", "LOCATION"), F.when(says("headquartered", "based in"), "HEADQUARTERED_IN").otherwise("LOCATED_IN"))
        .when((a == "PERSON") & (b == "PERSON"), F.when(says("married", "spouse"), "MARRIED_TO").when(says("colleague", "partner"), "COLLEAGUE_OF").otherwise("KNOWS"))
        .otherwise("RELATED_TO")
    )


# Fixed values: (types of the two, [(words in the window, relation, confidence), ...]); words None: otherwise.
PEOPLE = ("PERSON", "CHARACTER", "SPEAKER")
WINDOW_RULES = [
    ([(p, p) for p in PEOPLE], [
        (("said", "replied", "responded"), "RESPONDS_TO", 0.85), (("asked", "questioned"), "QUESTIONS", 0.85), (("taught", "explained"), "TEACHES", 0.8), (("discussed", "spoke about"), "DISCUSSES", 0.8),
        (("loved", "admired"), "ADMIRES", 0.85), (("argued", "disagreed"), "ARGUES_WITH", 0.85), (("met", "encountered"), "MEETS", 0.75), (None, "INTERACTS_WITH", 0.6)]),
    ([(p, "CONCEPT") for p in PEOPLE], [(("discussed", "spoke of"), "DISCUSSES", 0.8), (("defined", "described"), "DEFINES", 0.85), (("questioned", "wondered about"), "QUESTIONS", 0.8), (None, "MENTIONS", 0.7)]),
    ([("CONCEPT", p) for p in PEOPLE], [(None, "DISCUSSED_BY", 0.7)]),
    ([("PERSON", "ORGANIZATION"), ("ORGANIZATION", "PERSON")], [(("works for", "employed by"), "WORKS_FOR", 0.9), (("founded", "ceo", "leads"), "LEADS", 0.9), (None, "ASSOCIATED_WITH", 0.65)]),
    ([("PERSON", "LOCATION"), ("CHARACTER", "LOCATION")], [(("born in", "from"), "BORN_IN", 0.9), (("lives in", "resides in"), "LIVES_IN", 0.85), (("traveled to", "visited"), "VISITED", 0.8), (None, "LOCATED_IN", 0.7)]),
    ([("ORGANIZATION", "LOCATION"), ("LOCATION", "ORGANIZATION")], [(("headquartered", "based in"), "HEADQUARTERED_IN", 0.9), (None, "LOCATED_IN", 0.75)]),
    ([("CONCEPT", "CONCEPT")], [(("similar to", "related to"), "RELATED_TO", 0.75), (("opposite", "contrasts with"), "CONTRASTS_WITH", 0.8), (None, "ASSOCIATED_WITH", 0.6)]),
    ([("PERSON", "EVENT"), ("CHARACTER", "EVENT")], [(None, "PARTICIPATES_IN", 0.75)]),
    ([("EVENT", "LOCATION")], [(None, "OCCURS_IN", 0.8)]),
]


def window_relations(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., name, other, relation_type, confidence): by types and the window from the first name to 50 beyond the last.

    Names of other types co-occur if they stand less than 100 characters apart.
    """
    keys = [c for c in df.columns if c != text]
    p = placed_pairs(df, found, keys, text).withColumn("window", F.substring("low", F.least("a", "b"), F.abs(F.col("a") - F.col("b")) + 50))
    table = [(x, y, [(list(marks or ()), relation, sure) for marks, relation, sure in rules]) for kinds, rules in WINDOW_RULES for x, y in kinds]
    rules = df.sparkSession.createDataFrame(table, "entity_type string, other_entity_type string, rules array<struct<marks:array<string>,relation_type:string,confidence:double>>")
    told = lambda r: (F.size(r["marks"]) == 0) | F.exists(r["marks"], lambda m: F.contains(F.col("window"), m))
    own = F.get(F.filter("rules", told), 0)
    out = p.join(F.broadcast(rules), ["entity_type", "other_entity_type"], "left").withColumn("r", own)
    near = F.col("rules").isNull() & (F.abs(F.col("a") - F.col("b")) < 100)
    relation, sure = F.when(near, "CO_OCCURS").otherwise(F.col("r.relation_type")), F.when(near, 0.5).otherwise(F.col("r.confidence"))
    return out.select(*keys, "name", "other", relation.alias("relation_type"), sure.alias("confidence")).where("relation_type is not null")


def co_mentions(found: DataFrame, keys: list[str]) -> DataFrame:
    """(name, other, shared): in how many chunks two names stand together."""
    return pairs_of(found.select(*keys, "name").distinct(), keys).groupBy("name", "other").agg(F.count("*").alias("shared"))


def concept_relations(found: DataFrame, keys: list[str]) -> DataFrame:
    """(name, other, shared, confidence): co-mentions with the Jaccard similarity of the two names' chunks."""
    own = found.select(*keys, "name").distinct().groupBy("name").agg(F.count("*").alias("n"))
    both = co_mentions(found, keys).join(own, "name").join(own.select(F.col("name").alias("other"), F.col("n").alias("m")), "other")
    return both.select("name", "other", "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("confidence"))


def facts_to_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of facts (subject, predicate, object, confidence, marker); of an entity's facts the surest counts.

    A marker's year is negative with BC; a plain year counts from 1970, within 1000 to 3000; years have 365 days.
    """
    ident = lambda c: F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")
    year = F.regexp_replace("marker", "[^0-9]", "").try_cast("long")
    day = 365 * 24 * 3600
    timed = facts.withColumn("at", F.when(F.contains("marker", F.lit("BC")), -year * day).when((year > 1000) & (year < 3000), (year - 1970) * day))
    ends = timed.select("confidence", "at", F.explode(F.array("subject", "object")).alias("name"))
    entities = ends.groupBy(ident(F.col("name")).alias("id")).agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"), F.min("at").alias("first_mentioned"), F.max("at").alias("last_mentioned"))
    entities = entities.withColumn("entity_type", type_of_fact(F.col("name")))
    low = F.lower("predicate")
    kind = F.when(F.col("at").isNull(), None).when(F.contains(low, F.lit("caused")) | F.contains(low, F.lit("led to")), "Caused").when(F.contains(low, F.lit("enabled")) | F.contains(low, F.lit("allowed")), "Enabled")
    timed = timed.withColumn("temporal_type", kind)
    strength = F.when(F.col("temporal_type") == "Caused", F.col("confidence")).when(F.col("temporal_type") == "Enabled", F.col("confidence") * 0.6)
    relationships = timed.select(ident(F.col("subject")).alias("source"), ident(F.col("object")).alias("target"), F.upper("predicate").alias("relation_type"), "confidence", F.col("at").alias("range_start"), "temporal_type", F.round(strength, 6).alias("causal_strength"))
    return entities, relationships
