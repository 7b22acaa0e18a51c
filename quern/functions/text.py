"""Text functions on columns: cleaning, sentences, tokens, similarity. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The most common English words, in their usual order; the lexical index leaves them out.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but", "his", "by", "from",
    "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up", "out", "if", "about", "who", "get", "which",
    "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into", "year", "your", "good", "some", "could", "them", "see", "other",
    "than", "then", "now", "look", "only", "come", "its", "over", "think", "also", "back", "after", "use", "two", "how", "our", "work", "first", "well", "way", "even", "new",
    "want", "because", "any", "these", "give", "day", "most", "us",
]
# What keyword extraction leaves out besides; how many of the common words plain frequency counts leave
# out; what the content key leaves out.
KEYWORD_STOP_WORDS = [*STOP_WORDS, "is", "was", "are", "been", "has", "had", "were", "said", "did"]
FREQUENT = STOP_WORDS[:50]
CONTENT_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is worked out once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column, over: int = 5) -> Column:
    """Sentences with their end marks, trimmed, of more than `over` characters."""
    parts = F.split(F.regexp_replace(text, r"([.!?]+)[ \t\n\r\f]+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > over)


def index_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower case, letters and digits only, more than two bytes, no stop words; repeats stay. One pass strips the whole text."""
    bare = words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} \t\n\r\f]", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~w.isin(stop))


def keyword_tokens(text: Column, stop: list[str] = KEYWORD_STOP_WORDS) -> Column:
    """As index_tokens, with hyphens and underlines kept and numbers left out."""
    bare = words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\- \t\n\r\f]", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~w.isin(stop) & ~w.rlike(r"^\p{N}+$"))


def frequent_tokens(text: Column) -> Column:
    """Words as they stand, in lower case, of more than three bytes, without the fifty commonest."""
    return F.filter(words(F.lower(text)), lambda w: (F.octet_length(w) > 3) & ~w.isin(FREQUENT))


def counted(words: Column) -> Column:
    """array<struct<n, word>>: the distinct words of an array in order, n being the number of each as a negative, so that sorting puts the most frequent first."""
    begins = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
    runs = lambda w: let(begins(w), lambda b: F.transform(b, lambda i, j: F.struct((i - F.coalesce(F.get(b, j + 1), F.size(w) + 1)).alias("n"), F.get(w, i - 1).alias("word"))))
    return let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cohesion(a: Column, b: Column) -> Column:
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def edit_similarity(a: Column, b: Column, most: int | None = None) -> Column:
    """1 - distance / longer length; 0 beyond `most` edits; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    near = F.when(longer == 0, 1.0).otherwise(1 - distance / longer)
    return near if most is None else F.when(distance > most, 0.0).otherwise(near)


def name_similarity(a: Column, b: Column, inside: float = 0.9) -> Column:
    """1 if equal, `inside` if one contains the other, else Jaccard of words; case doesn't matter."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), inside).otherwise(jaccard(words(x), words(y)))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """0.4 Jaccard + 0.4 containment + 0.2 edit similarity of lower-case texts."""
    x, y = F.lower(a), F.lower(b)
    return 0.4 * jaccard(words(x), words(y)) + 0.4 * containment(words(x), words(y)) + 0.2 * edit_similarity(x, y)


def language(text: Column) -> Column:
    """es, pt or fr by accents (the first that occurs in this order), else en."""
    return F.when(text.rlike("[ñóéíáú]"), "es").when(text.rlike("[ãõç]"), "pt").when(text.rlike("[àèùâêîôû]"), "fr").otherwise("en")


def heading_level(line: Column) -> Column:
    """1 to 6 by leading #; 1 to 3 for a line in capitals by its length; by depth for a section number; else null."""
    t = F.trim(line)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    capitals = (F.length(t) >= 5) & (letters > 0) & (F.upper(t) == t) & (F.lower(t) != t)
    number = F.regexp_extract(t, r"^([0-9]+(\.[0-9]+)*)\.?[ \t]", 1)
    return (
        F.when(t.rlike(r"^#{1,6} "), F.length(F.regexp_extract(t, "^(#+)", 1)))
        .when(capitals, F.when(F.length(t) < 20, 1).when(F.length(t) < 40, 2).otherwise(3))
        .when(number != "", F.size(F.split(number, r"\.")))
    )


def roman(numeral: Column) -> Column:
    """The value of a Roman numeral; null for other text."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv]), c)
    marks = F.filter(F.split(F.upper(numeral), ""), lambda c: c != "")
    first = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    add = lambda s, c: F.struct((s["total"] + F.when(value(c) > s["last"], value(c) - 2 * s["last"]).otherwise(value(c))).alias("total"), value(c).alias("last"))
    return F.when(numeral.rlike("^(?i)[IVXLCDM]+$"), F.aggregate(marks, first, add, lambda s: s["total"]))


def cache_key(text: Column, mode: str = "simple") -> Column:
    """sha256 of the text in lower case with single spaces; semantic: without punctuation; content: without stop words,
    unless it has nothing else."""
    low = clean(F.lower(text))
    if mode in ("semantic", "content"):
        low = clean(F.regexp_replace(low, r"[^\p{L}\p{N} ]", ""))
    if mode == "content":
        kept = F.filter(F.split(low, " "), lambda w: ~w.isin(CONTENT_STOP_WORDS))
        low = F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(low)
    return F.sha2(low, 256)


def edit_name_match(name: Column, asked: Column) -> Column:
    """Whether a name may be the asked one: its first word begins so (one word asked), the last words are equal, or few edits."""
    n, q = words(F.lower(name)), words(F.lower(asked))
    one = F.get(n, F.lit(0)).startswith(F.get(q, F.lit(0))) | F.get(q, F.lit(0)).startswith(F.get(n, F.lit(0)))
    last = F.get(n, F.size(n) - 1) == F.get(q, F.size(q) - 1)
    most = F.greatest(F.lit(1), F.floor(F.least(F.octet_length(name), F.octet_length(asked)) / 4))
    return F.when((F.size(q) == 1) & (F.size(n) > 0), one).otherwise(F.coalesce(last, F.lit(False)) | (F.levenshtein(F.lower(name), F.lower(asked)) <= most))


def language_en(text: Column) -> Column:
    """en where eight short words occur (as substrings) in over .05 of as many words; null for texts under ten bytes."""
    hits = sum((F.regexp_count(text, F.lit(w)) for w in ("the", "and", "or", "but", "in", "on", "at", "to")), F.lit(0))
    n = word_count(text)
    return F.when(F.octet_length(text) < 10, None).when((n > 0) & (hits / F.greatest(n, F.lit(1)) > 0.05), "en").otherwise("unknown")


# Letters with a phonetic code, and their codes.
CODED, CODES = "BFPVCGJKQSXZDTLMNR", "111122222222334556"


def phonetic_code(name: Column) -> Column:
    """The first letter and the codes that follow, equal neighbours once, whatever uncoded letters stand between; four characters."""
    u = F.regexp_replace(F.upper(name), "[0-9]", "")
    digits = lambda c: F.regexp_replace(F.translate(c, CODED, CODES), "[^1-6]", "")
    codes = F.regexp_replace(digits(u), r"([1-6])\1+", "$1")
    rest = F.when(digits(F.substring(u, 1, 1)) != "", F.substring(codes, 2, 100)).otherwise(codes)
    first = F.when(F.substring(u, 1, 1).rlike(r"\p{L}"), F.substring(u, 1, 1)).otherwise("")
    return F.when(F.length(name) == 0, "").otherwise(F.rpad(F.substring(F.concat(first, rest), 1, 4), 4, "0"))
