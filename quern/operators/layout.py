"""Lines, headings, sections and boundaries of texts, with true character offsets; all as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx

# Words that begin a heading line; kinds of numbered headings.
MARKERS = r"^(?:Chapter|Section|Part|Appendix|Introduction|Conclusion|Abstract|Summary)\b"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, i, line, start): each line and where it starts."""
    each = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    return each.withColumn("start", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).select(key, F.col("i").cast("long").alias("i"), "line", F.col("start").cast("long").alias("start"))


def starts_of(df: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """(key, position): where matches of a pattern start."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1"), "\u0001", -1)
    each = df.select(key, F.posexplode(F.transform(parts, lambda p: F.length(p))).alias("i", "n"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("position", F.sum("n").over(w)).where("i > 0").select(key, F.col("position").cast("long").alias("position"))


def markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, level, title, start, end): headings by leading #, numbered in order."""
    w = Window.partitionBy(key).orderBy("start")
    h = lines(df, key, text).where(F.col("line").rlike(r"^#{1,6} +[^ ]"))
    level = F.length(F.regexp_extract("line", "^(#+)", 1))
    return h.select(key, (F.row_number().over(w) - 1).cast("long").alias("at"), level.cast("int").alias("level"), F.trim(F.regexp_replace("line", "^#+", "")).alias("title"), "start", (F.col("start") + F.length("line")).alias("end"))


def plaintext(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, level, title, start): lines underlined by === (1) or --- (2), else by heading_level()."""
    w = Window.partitionBy(key).orderBy("i")
    below, above = F.lead("line").over(w), F.lag("line").over(w)
    h = lines(df, key, text).withColumn("below", below).withColumn("above", above).where("trim(line) <> ''")
    level = F.when(F.col("below").rlike("^={3,}$"), 1).when(F.col("below").rlike("^-{3,}$"), 2).when(F.col("line").rlike("^(={3,}|-{3,})$"), None).otherwise(tx.heading_level(F.col("line")))
    return h.withColumn("level", level.cast("int")).where("level is not null").select(key, "level", F.trim("line").alias("title"), "start")


def sections(headings: DataFrame, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, level, start, finish): from a heading's end to the next heading's start or the text's end."""
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("at"))
    size = df.select(key, F.length(text).cast("long").alias("size"))
    return headings.withColumn("next", nxt).join(size, key).select(key, "at", "level", F.col("end").alias("start"), F.coalesce("next", "size").alias("finish"))


def hierarchy(headings: DataFrame, key: str) -> DataFrame:
    """(key, at, level, parent_at, depth, path): the nearest earlier heading of each smaller level, six running maxima, no join.

    The path names the headings from the root: of each smaller level the latest one that no larger-scoped one has ended.
    """
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    h = headings
    for k in range(1, 6):
        h = h.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.struct("at", "title"))).over(before))
    seen = None
    chain = []
    for k in range(1, 6):  # a level's last heading counts if no heading above it came later
        ok = F.col(f"l{k}").isNotNull() & (F.col("level") > k)
        if seen is not None:
            ok = ok & (seen.isNull() | (F.col(f"l{k}.at") > seen))
        chain.append(F.when(ok, F.col(f"l{k}")))
        seen = F.when(ok, F.col(f"l{k}.at")).otherwise(seen if seen is not None else F.lit(None).cast("long"))
    path = F.filter(F.array(*chain), lambda x: x.isNotNull())
    h = h.withColumn("path", path)
    return h.select(key, "at", "level", F.element_at("path", F.when(F.size("path") > 0, -1).otherwise(F.lit(None)))["at"].alias("parent_at"), (F.size("path") + 1).cast("long").alias("depth"), F.array_join(F.concat(F.transform("path", lambda x: x["title"]), F.array("title")), " > ").alias("path"))


def section_of(places: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Adds to places (key, offset) the section (at) that holds the offset: one window over both, no join by range."""
    rest = [c for c in places.columns if c not in (key, "offset")]
    both = places.select(key, F.col("offset").alias("p"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("finish"), F.struct(F.col("offset"), *rest).alias("own"))
    own = both.schema["own"].dataType
    marks = found.select(key, F.col("start").alias("p"), F.lit(0).alias("side"), "at", "finish", F.lit(None).cast(own).alias("own"))
    w = Window.partitionBy(key).orderBy("p", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("at", "finish")), ignorenulls=True).over(w)
    j = both.unionByName(marks).withColumn("s", last).where("side = 1")
    return j.select(key, F.col("own.offset").alias("offset"), *[F.col(f"own.{c}") for c in rest], F.when(F.col("own.offset") < F.col("s.finish"), F.col("s.at")).alias("section"))


def boundaries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, position, kind, confidence) of five kinds: paragraph, heading, list, code and sentence ends."""
    w = Window.partitionBy(key).orderBy("i")
    row = lambda d, kind, sure, at="start": d.select(key, F.col(at).alias("position"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    ln = lines(df, key, text).withColumn("below", F.lead("line").over(w)).withColumn("above", F.lag("line").over(w))
    item = lambda c: F.coalesce(F.col(c).rlike(r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]"), F.lit(False))
    indented = lambda c: F.coalesce(F.col(c).rlike(r"^(    |\t)[^ \t]"), F.lit(False))
    caps = (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= 5) & (F.upper("line") == F.col("line")) & (F.length(F.trim("line")) < 80)
    heading = F.when(F.col("line").rlike("^#{1,6} "), 0.95).when((F.trim("line") != "") & F.col("below").rlike("^(={3,}|-{3,}|~{3,})$"), 0.9).when(F.col("line").rlike(MARKERS), 0.85).when(caps, 0.7)
    parts = [
        row(starts_of(df, key, r"\n[ \t\r\f]*\n", text), "paragraph", 1.0, "position"),
        ln.withColumn("c", heading).where("c is not null").select(key, F.col("start").alias("position"), F.lit("heading").alias("kind"), F.col("c").alias("confidence")),
        row(ln.where(item("line") & ~item("above")), "list", 0.9), row(ln.where(item("line") & ~item("below") & item("above")), "list", 0.9),
        row(ln.where(F.col("line").rlike("^```")), "code", 1.0), row(ln.where(indented("line") & ~indented("above")), "code", 0.7),
        row(starts_of(df, key, r"[.!?]+[ \t\n\r\f]+", text).where("position >= 10"), "sentence", 0.9, "position"),
    ]
    return reduce(DataFrame.unionByName, parts)


def merged(found: DataFrame, key: str) -> DataFrame:
    """One boundary for each position, the surest, of equals the first kind by name."""
    return found.groupBy(key, "position").agg(F.min(F.struct((-F.col("confidence")).alias("o"), "kind", "confidence")).alias("b")).select(key, "position", "b.kind", "b.confidence")


def section_number(title: Column) -> Column:
    """The parts of a heading's number, dot-joined: decimal, chapter and the like with a number or letter, or Roman."""
    decimal = F.regexp_extract(title, r"^([0-9]+(?:\.[0-9]+)*)[.)]?(?: |$)", 1)
    word = F.regexp_extract(title, r"^(?i)(?:chapter|section|part|appendix) +([0-9]+(?:\.[0-9]+)*|[A-Z])\b", 1)
    roman = F.regexp_extract(title, r"^([IVXLCDM]+)[.)] ", 1)
    letter = F.regexp_extract(title, r"^([A-Z])[.)] ", 1)
    return F.when(decimal != "", decimal).when(word != "", F.upper(word)).when(roman != "", tx.roman(roman).cast("string")).when(letter != "", letter)


def paragraphs(text: Column, most: int = 1000) -> Column:
    """Paragraphs (between blank lines), packed in order while a chunk has at most `most` characters."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), lambda p: F.trim(p)), lambda p: p != "")
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    add = lambda s, p: F.when(s["now"] == "", F.struct(s["done"].alias("done"), p.alias("now"))).when(F.length(s["now"]) + 2 + F.length(p) <= most, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit("\n\n"), p).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), p.alias("now")))
    return F.aggregate(parts, first, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def topics(sentences: DataFrame, key: str, least: float = 0.7, size: int = 100) -> DataFrame:
    """(key, topic, sentences, content): runs of sentences (key, at, s) whose neighbours share at least this part of their words."""
    w = Window.partitionBy(key).orderBy("at")
    s = sentences.withColumn("w", tx.words(F.lower("s")))
    new = F.coalesce(tx.jaccard(F.lag("w").over(w), F.col("w")) < least, F.lit(True))
    runs = s.withColumn("new", new.cast("long")).withColumn("topic", F.sum("new").over(w)).groupBy(key, "topic").agg(F.count("*").alias("sentences"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("x"))
    return runs.select(key, "topic", "sentences", F.array_join(F.transform("x", lambda y: y["s"]), " ").alias("content")).where(F.length("content") >= size)
