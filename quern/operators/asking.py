"""What a question asks: type, intent, complexity, parts and logic forms; on rows (ask_id, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

# Words and phrases of the rules below.
ABSTRACT = ["concept", "idea", "theory", "principle", "philosophy", "meaning", "understanding", "knowledge", "wisdom", "truth", "beauty", "justice"]
QUESTION = ["what", "how", "why", "when", "where", "who", "which", "explain", "describe"]
INTENTS = [
    ("Overview", ["overview", "summary", "general", "about"]), ("Detailed", ["detailed", "specific", "exactly", "precise"]), ("Comparative", ["compare", "vs", "versus", "between", "difference"]),
    ("Causal", ["cause", "why", "because", "lead", "result"]), ("Temporal", ["when", "time", "before", "after", "during"]),
]
STOP = ["the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but", "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up", "out", "if", "about", "who", "get", "which", "go", "me"]
#: (vector, graph, hierarchy) by type and, for two types, by whether an overview is asked for.
STRATEGIES = {"EntityFocused": (0.5, 0.4, 0.1), "Relationship": (0.3, 0.6, 0.1), "Conceptual/Overview": (0.2, 0.2, 0.6), "Conceptual": (0.4, 0.3, 0.3), "Exploratory/Overview": (0.3, 0.2, 0.5), "Exploratory": (0.4, 0.4, 0.2), "Factual": (0.6, 0.3, 0.1)}
#: (vector, graph, hierarchy, lexical) by type, for an analysis of at least .6 confidence; else even.
ADAPTIVE = {"EntityFocused": (0.2, 0.5, 0.2, 0.1), "Conceptual": (0.6, 0.1, 0.3, 0.0), "Factual": (0.2, 0.1, 0.1, 0.6), "Relationship": (0.2, 0.6, 0.1, 0.1), "Exploratory": (0.25, 0.25, 0.25, 0.25)}
BROAD = ["overview", "summary", "summarize", "main", "general", "all", "themes", "topics", "overall", "broadly", "big picture", "what are", "list all", "show me all"]
NARROW = ["relationship between", "how does", "why does", "specific", "detail", "exactly", "precisely", "what is the connection", "explain how", "describe the", "between", "and"]
CONCEPTUAL = ["what is", "what are", "nature of", "meaning of", "definition of", "concept of", "idea of", "philosophy of", "theory of", "how does", "why does", "explain"]
#: Kinds of a question by what it has (contains) or begins with, in this order, and what its first template turns into.
KINDS = [
    ("Relationship", ["relationship between", "how does", "related to", "connection between"], []), ("EntityLookup", [], ["who is", "what is", "define"]), ("Aggregation", ["total", "sum", "average"], ["how many", "count"]),
    ("Comparison", ["compare", "difference between", "versus", "vs"], []), ("Temporal", ["when", "before", "after", "during", "timeline"], []), ("Causal", ["why", "because", "cause", "reason", "led to"], []),
]
TEMPLATES = [("EntityLookup", "who is", "entity:"), ("EntityLookup", "what is", "define:"), ("Aggregation", "how many", "count:"), ("Comparison", "compare", "compare:")]
SYNONYMS = {"find": ["search", "locate"], "person": ["individual", "people"], "company": ["organization", "business", "firm"], "show": ["display", "present"], "get": ["retrieve", "fetch"], "large": ["big", "huge", "significant"], "small": ["tiny", "minor"], "important": ["significant", "critical", "key"]}
TERM_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]
#: Intents by keywords and patterns.
CLASSES = [
    ("Factual", ["what", "which", "how many", "how much"], [r"\bwhat (?:is|are|was|were)\b", r"\bwhich (?:is|are|was|were)\b", r"\bhow many\b", r"\bhow much\b"]),
    ("Definitional", ["define", "definition", "meaning", "explain", "what is"], [r"\bdefine\b", r"\bdefinition of\b", r"\bmeaning of\b", r"\bexplain what\b", r"\bwhat (?:is|are) (?:the )?(?:concept|idea|notion) of\b"]),
    ("Relational", ["relationship", "related", "connection", "between", "and"], [r"\brelationship between\b", r"\bhow (?:is|are) .+ related to\b", r"\bconnection between\b", r"\b\w+ and \w+\b"]),
    ("Temporal", ["when", "time", "date", "year", "before", "after", "during"], [r"\bwhen (?:did|was|were|will|is|are)\b", r"\bwhat (?:time|date|year)\b", r"\bbefore .+ happened\b", r"\bafter .+ happened\b", r"\bduring .+ period\b"]),
    ("Causal", ["why", "because", "cause", "reason", "result", "due to"], [r"\bwhy (?:did|was|were|is|are|do|does)\b", r"\bwhat (?:caused|causes)\b", r"\breason for\b", r"\bdue to what\b", r"\bwhat led to\b"]),
    ("Comparative", ["compare", "difference", "versus", "vs", "better", "worse", "similar"], [r"\bcompare .+ (?:to|with|and)\b", r"\bdifference between\b", r"\b.+ (?:versus|vs) .+\b", r"\bwhich is (?:better|worse)\b", r"\bhow (?:similar|different)\b"]),
    ("Summary", ["summarize", "overview", "summary", "tell me about", "describe"], [r"\bsummarize\b", r"\bgive (?:me )?(?:an )?overview\b", r"\btell me about\b", r"\bdescribe .+\b", r"\bwhat (?:can you tell me )?about\b"]),
]
INAPPROPRIATE = r"\b(?:hate|violence|harm|illegal|inappropriate)\b"
SEPARATORS = ["and", "or", "but", "also", "furthermore", "moreover", "however", "therefore"]
#: Logic forms by pattern, the first that matches; an argument's question mark isn't part of it.
FORMS = [
    ("Is", r"(?i)what (?:is|are) (?:the )?(.+?)\??$", 1), ("Is", r"(?i)who (?:is|are) (?:the )?(.+?)\??$", 1), ("Related", r"(?i)how (?:is|are) (.+?) (?:related to|connected to) (.+?)\??$", 2),
    ("Happened", r"(?i)when (?:did|does|will) (.+?) (?:happen|occur)\??", 1), ("Caused", r"(?i)why (?:did|does) (.+?) (?:cause|lead to) (.+?)\??$", 2), ("Compare", r"(?i)compare (.+?) (?:and|with|to) (.+?)(?:\s+(?:on|in terms of) (.+?))?\??$", 2),
]


def has(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks], F.lit(False))


def count(text: Column, marks: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m)))


def analyze(asks: DataFrame, entities: DataFrame) -> DataFrame:
    """(ask_id, n_entities, n_concepts, query_type, intent, complexity). asks is a stated, short set, met with all entities."""
    low = asks.select("ask_id", tx.words(F.lower("text")).alias("w"))
    words = low.select("ask_id", F.explode(F.array_distinct("w")).alias("word"))
    names = entities.select("id", F.lower("name").alias("name"))
    hits = names.join(F.broadcast(words), F.contains("name", F.col("word")) | F.contains("word", F.col("name")))
    known = hits.groupBy("ask_id", "word").agg(F.lit(True).alias("known"))
    found = hits.groupBy("ask_id").agg(F.countDistinct("id").alias("n_entities"))
    loose = low.select("ask_id", F.explode("w").alias("word")).where((F.octet_length("word") > 3) & ~F.col("word").isin(STOP)).join(known, ["ask_id", "word"], "left_anti").groupBy("ask_id").agg(F.count("*").alias("n_concepts"))
    q = low.join(found, "ask_id", "left").join(loose, "ask_id", "left").na.fill(0, ["n_entities", "n_concepts"])
    any_word = lambda ws: F.arrays_overlap("w", F.array(*[F.lit(x) for x in ws]))
    kind = F.when(F.col("n_entities") > 1, "Relationship").when(F.col("n_entities") == 1, "EntityFocused").when(any_word(ABSTRACT), "Conceptual").when(any_word(QUESTION), "Exploratory").otherwise("Factual")
    intent = F.lit("Detailed")
    for name, ws in reversed(INTENTS):
        intent = F.when(any_word(ws), name).otherwise(intent)
    score = F.round(F.least(F.lit(1.0), 0.1 * F.size("w") + 0.3 * F.col("n_entities") + 0.2 * F.col("n_concepts")), 6)
    return q.select("ask_id", "n_entities", "n_concepts", kind.alias("query_type"), intent.alias("intent"), score.alias("complexity"))


def _weights(kind: Column, table: dict[str, tuple], names: list[str]) -> list[Column]:
    out = []
    for i, n in enumerate(names):
        c = F.lit(None).cast("double")
        for k, w in table.items():
            c = F.when(kind == k, w[i]).otherwise(c)
        out.append(c.alias(n))
    return out


def strategy_weights(analysis: DataFrame) -> DataFrame:
    over = F.col("query_type").isin("Conceptual", "Exploratory") & (F.col("intent") == "Overview")
    return analysis.select("ask_id", *_weights(F.when(over, F.concat("query_type", F.lit("/Overview"))).otherwise(F.col("query_type")), STRATEGIES, ["vector", "graph", "hierarchy"]))


def adaptive_weights(analysis: DataFrame, confidence: str = "confidence") -> DataFrame:
    return analysis.select("ask_id", *_weights(F.when(F.col(confidence) < 0.6, "Exploratory").otherwise(F.col("query_type")), ADAPTIVE, ["vector", "graph", "hierarchy", "lexical"]))


def breadth(asks: DataFrame, most_level: int = 3) -> DataFrame:
    """(ask_id, score, breadth, level): .5 keywords + .3 length + .2 marks of entities, as a community level."""
    low = F.lower("text")
    b, n = count(low, BROAD), count(low, NARROW)
    keywords = F.when(b + n > 0, (b - n) / (b + n)).otherwise(0.0)
    size = tx.word_count(F.col("text"))
    length = F.when(size.between(1, 3), 0.5).when(size.between(4, 5), 0.2).when(size.between(6, 7), 0.0).when(size.between(8, 10), -0.3).otherwise(-0.5)
    marks = F.floor(F.regexp_count(low, F.lit('"')) / 2) + F.regexp_count(low, F.lit(" and ")) + F.regexp_count(low, F.lit("between"))
    entities = F.when(marks == 0, 0.3).when(marks == 1, 0.0).when(marks == 2, -0.4).otherwise(-0.7)
    q = asks.select("ask_id", F.round(0.5 * keywords + 0.3 * length + 0.2 * entities, 6).alias("score"))
    kind = F.when(F.col("score") >= 0.7, "VeryBroad").when(F.col("score") >= 0.4, "Broad").when(F.col("score") >= -0.2, "Medium").when(F.col("score") >= -0.5, "Specific").otherwise("VerySpecific")
    level = {"VeryBroad": max(2, most_level), "Broad": max(1, most_level - 1), "Medium": 1, "Specific": 0, "VerySpecific": 0}
    q = q.withColumn("breadth", kind)
    return q.withColumn("level", reduce(lambda c, k: F.when(F.col("breadth") == k, level[k]).otherwise(c), level, F.lit(0)))


def kind_of(low: Column) -> Column:
    out = F.lit("General")
    for name, inside, begins in reversed(KINDS):
        out = F.when(reduce(lambda a, b: a | b, [low.startswith(b) for b in begins], has(low, inside)), name).otherwise(out)
    return out


def rewrite(asks: DataFrame, relevance: float = 0.5) -> DataFrame:
    """(ask_id, kind, rewritten, n_terms, confidence): template, synonyms after their words, terms without stop words."""
    low = F.trim(F.lower("text"))
    turned = low
    for kind, pattern, new in reversed(TEMPLATES):
        turned = F.when((kind_of(low) == kind) & F.contains(low, F.lit(pattern)), F.replace(low, F.lit(pattern), F.lit(new))).otherwise(turned)
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    q = asks.select("ask_id", low.alias("low"), kind_of(low).alias("kind"), tx.words(turned).alias("w"))
    grow = lambda done, w: F.concat(done, F.array(w), F.filter(F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")), lambda s: ~F.array_contains(F.concat(done, F.array(w)), s)))
    q = q.withColumn("w", F.aggregate("w", F.array().cast("array<string>"), grow))
    q = q.withColumn("n", F.size(F.filter("w", lambda x: ~x.isin(TERM_STOP))))
    sure = F.when(F.col("n") == 0, 0.5).otherwise(0.6 * F.least(F.lit(1.0), F.col("n") / (tx.word_count(F.col("low")) + 1)) + 0.4 * relevance)
    return q.select("ask_id", "kind", F.array_join("w", " ").alias("rewritten"), F.col("n").cast("long").alias("n_terms"), F.round(sure, 6).alias("confidence"))


def feedback(votes: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """(key, relevance): each vote in order moves the relevance, .5 at first, half way to its score."""
    seen = votes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, score))).alias("v"))
    return seen.select(key, F.round(F.aggregate("v", F.lit(0.5), lambda r, v: r * 0.5 + v[score].cast("double") * 0.5), 6).alias("relevance"))


def classify(asks: DataFrame, least: float = 0.3) -> DataFrame:
    """(ask_id, intent, confidence, refuse): half keywords, half patterns; ambiguous if a runner-up has over .8 of the best."""
    low = F.lower("text")
    share = lambda ws, ps: F.round(F.least(F.lit(1.0), 0.5 * count(low, ws) / len(ws) + 0.5 * reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in ps]) / len(ps)), 6)
    scores = F.array(*[F.struct((-share(ws, ps)).alias("o"), F.lit(n).alias("intent")) for n, ws, ps in CLASSES])
    q = asks.select("ask_id", low.rlike(INAPPROPRIATE).alias("bad"), F.sort_array(F.filter(scores, lambda s: s["o"] < 0)).alias("s"))
    best, second = -F.get("s", F.lit(0))["o"], -F.get("s", F.lit(1))["o"]
    vague = F.coalesce(second > 0.8 * best, F.lit(False)) | (F.size("s") == 0)
    intent = F.when(F.col("bad"), "Inappropriate").when(vague, "Ambiguous").otherwise(F.get("s", F.lit(0))["intent"])
    return q.select("ask_id", intent.alias("intent"), F.when(F.col("bad"), 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("confidence"), (F.col("bad") | vague | F.coalesce(best < least, F.lit(True))).alias("refuse"))


def complexity(text: Column) -> Column:
    """Of length, sentences, length of words and conjunctions, at most 1."""
    n, marks = tx.word_count(text), F.greatest(F.regexp_count(text, F.lit("[.?!]")), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))
    joined = has(text, [" and ", " or ", " but ", " because ", " since ", " although "])
    return F.round(F.least(F.lit(1.0), 0.3 * F.least(n / 20, F.lit(1.0)) + 0.2 * F.least(marks / 3, F.lit(1.0)) + 0.2 * F.least(letters / 8, F.lit(1.0)) + F.when(joined, 0.3).otherwise(0.0)), 6)


def clauses(asks: DataFrame) -> DataFrame:
    """(ask_id, place, clause, kind, priority): split before separating words and marks, which go; a short clause goes too.

    A question of one clause stays whole. Separators count as words, not inside others.
    """
    words = "|".join(SEPARATORS)
    parts = F.split(F.regexp_replace("text", rf"(?i)(\b(?:{words})\b|[,;])", "\u0001$1"), "\u0001")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), rf"(?i)^(?:(?:{words})\b|[,;])", "")))
    q = asks.withColumn("c", F.filter(bare, lambda c: F.octet_length(c) > 3))
    q = q.withColumn("c", F.when(F.size("c") > 1, F.col("c")).otherwise(F.array("text")))
    return q.select("ask_id", F.posexplode("c").alias("place", "clause")).select("ask_id", F.col("place").cast("long").alias("place"), "clause", kind_of_clause(F.col("clause")).alias("kind"), F.round(1 - 0.1 * F.col("place"), 6).alias("priority"))


def kind_of_clause(clause: Column) -> Column:
    low = F.lower(clause)
    return (
        F.when(low.startswith("who") | low.startswith("what person"), "Entity").when(low.startswith("what"), "Definitional").when(low.startswith("when"), "Temporal")
        .when(low.startswith("why") | F.contains(low, F.lit("because")), "Causal").when(has(low, ["relation", "connect"]), "Relationship").when(has(low, ["compare", "versus"]), "Comparative").otherwise("Attribute")
    )


def decompose(asks: DataFrame) -> DataFrame:
    """(ask_id, place, part, strategy): by patterns, else by conjunctions; a question that neither splits stays whole."""
    t = F.col("text")
    two, related = r"\b(who|what) is (.+?) and (.+)", r"\bhow (?:is|are) (.+?) (?:related to|connected to) (.+)"
    g = lambda p, i: F.regexp_extract(t, p, i)
    first = F.array(F.concat_ws(" is ", g(two, 1), g(two, 2)), g(two, 3))
    three = F.array(F.concat(F.lit("What is "), g(related, 1)), F.concat(F.lit("What is "), g(related, 2)), F.concat(F.lit("How are "), g(related, 1), F.lit(" and "), g(related, 2), F.lit(" related")))
    loose = F.array(t)
    for word in reversed(["and", "or", "but", "also", "furthermore"]):
        loose = F.when(t.rlike(rf"\b{word}\b"), F.split(t, rf"\b{word}\b")).otherwise(loose)
    hit = F.when(t.rlike(two), F.struct(first.alias("parts"), F.lit("semantic").alias("strategy"))).when(t.rlike(related), F.struct(three.alias("parts"), F.lit("semantic").alias("strategy")))
    hit = hit.otherwise(F.struct(loose.alias("parts"), F.when(F.size(loose) > 1, "conjunction").otherwise("single").alias("strategy")))
    q = asks.select("ask_id", hit.alias("h")).select("ask_id", F.posexplode(F.filter(F.transform("h.parts", lambda p: F.trim(p)), lambda p: p != "")).alias("place", "part"), "h.strategy")
    return q.select("ask_id", F.col("place").cast("long").alias("place"), "part", "strategy")


def dependencies(parts: DataFrame) -> DataFrame:
    """(ask_id, later, earlier, kind) of rows (ask_id, place, kind): which parts must be answered first."""
    e = parts.select("ask_id", F.col("place").alias("earlier"), F.col("kind").alias("earlier_kind"))
    p = parts.select("ask_id", F.col("place").alias("later"), F.col("kind").alias("later_kind")).join(e, "ask_id").where("earlier < later")
    named = F.col("earlier_kind").isin("Entity", "Definitional")
    refer = (F.col("later_kind").isin("Relationship", "Attribute") & named) | ((F.col("later_kind") == "Comparative") & (named | (F.col("earlier_kind") == "Attribute")))
    first = F.min(F.when(F.col("earlier_kind") == "Entity", F.col("earlier"))).over(Window.partitionBy("ask_id", "later"))
    context = (F.col("later_kind") == "Temporal") & (F.col("earlier") == first)
    after = (F.col("later_kind") == "Causal") & (F.col("earlier") == F.col("later") - 1) & F.col("earlier_kind").isin("Entity", "Temporal", "Relationship")
    return p.withColumn("kind", F.when(refer, "Reference").when(context, "Context").when(after, "Sequential")).where("kind is not null").select("ask_id", "later", "earlier", "kind")


def logic_forms(asks: DataFrame) -> DataFrame:
    """(ask_id, predicate, x, y): the first form that a question has; y is null for forms of one argument."""
    out = F.lit(None).cast("struct<predicate:string,x:string,y:string>")
    for name, pattern, n in reversed(FORMS):
        got = F.struct(F.lit(name).alias("predicate"), F.trim(F.regexp_extract("text", pattern, 1)).alias("x"), (F.trim(F.regexp_extract("text", pattern, 2)) if n == 2 else F.lit(None).cast("string")).alias("y"))
        out = F.when(F.col("text").rlike(pattern), got).otherwise(out)
    return asks.select("ask_id", out.alias("f")).where("f is not null").select("ask_id", "f.*")


def named(forms: DataFrame, entities: DataFrame, side: str) -> DataFrame:
    """(ask_id, id, name, entity_type) of entities whose name holds the argument; forms are few and broadcast."""
    asked = forms.where(F.col(side).isNotNull() & (F.col(side) != "")).select("ask_id", F.lower(side).alias("arg"))
    return entities.join(F.broadcast(asked), F.contains(F.lower("name"), F.col("arg"))).select("ask_id", "id", "name", "entity_type")


def logic_is(forms: DataFrame, entities: DataFrame) -> DataFrame:
    return named(forms.where("predicate = 'Is'"), entities, "x")


def logic_related(forms: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between what the two arguments name, either way."""
    f = forms.where("predicate = 'Related'")
    x, y = named(f, entities, "x").select("ask_id", F.col("id").alias("a")), named(f, entities, "y").select("ask_id", F.col("id").alias("b"))
    one = edges.join(x, F.col("source") == F.col("a")).join(y, ["ask_id"]).where("target = b")
    two = edges.join(x, F.col("target") == F.col("a")).join(y, ["ask_id"]).where("source = b")
    return one.union(two).select("ask_id", "source", "target", "relation_type").distinct()


def logic_compare(forms: DataFrame, entities: DataFrame) -> DataFrame:
    """(ask_id, x_types, y_types, same): the types that the two arguments name."""
    f = forms.where("predicate = 'Compare'")
    types = lambda side: named(f, entities, side).groupBy("ask_id").agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias(f"{side}_types"))
    return types("x").join(types("y"), "ask_id").withColumn("same", F.col("x_types") == F.col("y_types"))


def fuzzy(forms: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """(ask_id, id, score, how, rank): entities that equal the argument 1, that are like it .9 x likeness (.6 at least), or whose type it names .7."""
    asked = forms.select("ask_id", F.lower("x").alias("arg"))
    p = entities.join(F.broadcast(asked), (F.lower("name") == F.col("arg")) | F.contains("arg", F.lower("entity_type")) | F.arrays_overlap(tx.words(F.lower("name")), tx.words(F.col("arg"))))
    p = p.withColumn("s", tx.fuzzy_similarity(F.col("name"), F.col("arg")))
    how = F.when(F.lower("name") == F.col("arg"), "exact").when(F.col("s") >= 0.6, "partial").when(F.contains("arg", F.lower("entity_type")), "type")
    score = F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "partial", 0.9 * F.col("s")).otherwise(0.7)
    p = p.withColumn("how", how).where("how is not null").select("ask_id", "id", F.round(score, 6).alias("score"), "how")
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= k)


def match_confidence(matches: DataFrame) -> DataFrame:
    """(ask_id, confidence, strategy): similarity weighted by how it was found and by 1 / rank; the surest kind of match."""
    w = F.when(F.col("how") == "exact", 1.0).when(F.col("how") == "partial", 0.8).otherwise(0.5) / F.col("rank")
    strategy = F.when(F.bool_or(F.col("how") == "exact"), "ExactMatch").when(F.bool_or(F.col("how") == "partial"), "PartialMatch").otherwise("TypeMatch")
    return matches.groupBy("ask_id").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 6).alias("confidence"), strategy.alias("strategy"))


def synthesize(parts: DataFrame, key: str, order: str, text: str = "text", sure: str = "confidence") -> DataFrame:
    """One row for each key and way: sequential (in order, mean), weighted (surest first, root of the mean square),
    best_only (the surest), smart_merge (each text once, in order, mean of the best of each), hierarchical (the best, then the rest)."""
    rows = parts.select(key, F.col(order).alias("o"), F.col(text).alias("t"), F.col(sure).alias("c"))
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "t", "c"))).alias("q"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("n"), "o", "t", "c"))).alias("s"))
    texts = lambda c: F.transform(c, lambda x: x["t"])
    mean = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x)) / F.size(c)
    once = F.filter(F.col("q"), lambda x: F.array_position(texts(F.col("q")), x["t"]) > 0)
    made = lambda name, content, c: F.struct(F.lit(name).alias("way"), F.md5(content).alias("content_md5"), F.round(c, 6).alias("confidence"))
    top = F.get("s", F.lit(0))
    ways = F.array(
        made("sequential", F.array_join(texts("q"), "\n"), mean(F.col("q"), lambda x: x["c"])), made("weighted", F.array_join(texts("s"), "\n"), F.sqrt(mean(F.col("s"), lambda x: x["c"] * x["c"]))),
        made("best_only", top["t"], top["c"]), made("smart_merge", F.array_join(F.array_distinct(texts(once)), " "), mean(F.col("q"), lambda x: x["c"])), made("hierarchical", F.concat(top["t"], F.lit("\n\n"), F.array_join(F.slice(texts("s"), 2, 1000000), "\n")), top["c"]),
    )
    return g.select(key, F.explode(ways).alias("w")).select(key, "w.*")
