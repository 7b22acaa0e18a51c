"""Entity linking and merging on rows (id, name[, kind, confidence]).

Distinct names are compared, never rows: a name's copies are one from the start. Names meet only within a
block: those of a type that share a word, or that a deletion neighbourhood brings together, so no block grows
into all pairs of a table. Clusters are stars: in order of name, a name that no earlier seed took becomes a
seed and takes what is near it and free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.similarity import jaro_winkler_pairs
from quern.runtime import stage


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least `order` for each key."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("r")).select(*keys, f"r.{order}", *[f"r.{c}" for c in rest])


def link_exact(rows: DataFrame) -> DataFrame:
    """(id, name, members, canonical_id, confidence) of names, but for case, that several rows have."""
    n = rows.select("id", F.lower("name").alias("name"))
    groups = n.groupBy("name").agg(F.count("*").alias("members"), F.min("id").alias("canonical_id")).where("members > 1")
    return n.join(groups, "name").select("id", "name", "members", "canonical_id", F.lit(1.0).alias("confidence"))


def edit_similarity(a, b, most: int = 2):
    """1 - distance / longer length in bytes; 0 beyond `most` edits."""
    d = F.levenshtein(a, b)
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).when(d > most, 0.0).otherwise(1 - d / longer)


def deletions(name, most: int = 2):
    """A name and what is left of it without one or two characters: names within two edits share one of them."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    every = F.array_union(F.array(name), one(name))
    return every if most < 2 else F.array_distinct(F.array_union(every, F.flatten(F.transform(one(name), one))))


def near_names(names: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys..., a, b, score), a < b: names of a block within two edits and of at least this similarity."""
    each = names.select(*keys, "name", F.explode(deletions(F.col("name"))).alias("rest"))
    pairs = each.join(each.select(*keys, F.col("name").alias("other"), "rest"), [*keys, "rest"]).where("name < other").select(*keys, F.col("name").alias("a"), F.col("other").alias("b")).distinct()
    return pairs.withColumn("score", edit_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)


def similar_names(names: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys..., a, b, score), a < b: by the best of edit, Jaro-Winkler and word similarity, for names of a block that
    share a word or lie within two edits."""
    words = names.select(*keys, "name", F.explode(F.array_distinct(tx.words(F.col("name")))).alias("word"))
    shared = words.join(words.select(*keys, F.col("name").alias("other"), "word"), [*keys, "word"]).where("name < other").select(*keys, F.col("name").alias("a"), F.col("other").alias("b"))
    near = near_names(names, keys, 0.0).where(F.levenshtein("a", "b") <= 2).select(*keys, "a", "b")
    pairs = shared.union(near).distinct()
    jw = F.pandas_udf(jaro_winkler_pairs, "double")
    best = F.greatest(edit_similarity(F.col("a"), F.col("b")), jw("a", "b"), tx.jaccard(tx.words(F.col("a")), tx.words(F.col("b")), 1.0))
    return pairs.withColumn("score", best).where(F.col("score") >= least)


def stars(names: DataFrame, pairs: DataFrame, keys: list[str], most_rounds: int = 200) -> DataFrame:
    """(keys..., name, seed): greedy stars by order of name. A name is settled once all lesser names near it are:
    it is a seed if none of those is one, else it joins the least seed near it. Each round settles at least the
    least open name of every group."""
    near = stage(pairs.select(*keys, F.col("a").alias("less"), F.col("b").alias("name")), "near")
    state = stage(names.select(*keys, "name").distinct().join(near.select(*keys, "name").distinct().withColumn("open", F.lit(True)), [*keys, "name"], "left").withColumn("seed", F.when(F.col("open").isNull(), F.col("name"))).drop("open"), "stars")
    for _ in range(most_rounds):
        if state.where("seed is null").isEmpty():
            return state
        told = near.join(state.select(*keys, F.col("name").alias("less"), F.col("seed").alias("its")), [*keys, "less"])
        view = told.groupBy(*keys, "name").agg(F.min(F.when(F.col("its") == F.col("less"), F.col("less"))).alias("joins"), F.min(F.when(F.col("its").isNull(), F.col("less"))).alias("waits"))
        now = F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.col("joins").isNotNull() & (F.col("waits").isNull() | (F.col("joins") < F.col("waits"))), F.col("joins")).when(F.col("waits").isNull(), F.col("name"))
        state = stage(state.join(view, [*keys, "name"], "left").select(*keys, "name", now.alias("seed")), "stars")
    raise RuntimeError("clusters did not settle")


def link_similar(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, kind, name, cluster, canonical_id): stars of similar names of one kind; canonical: the surest member."""
    n = rows.withColumn("name", F.lower("name"))
    names = stage(n.select("kind", "name").distinct(), "names")
    seeds = stars(names, similar_names(names, ["kind"], least), ["kind"]).withColumnRenamed("seed", "cluster")
    joined = n.join(seeds, ["kind", "name"])
    best = joined.groupBy("kind", "cluster").agg(F.min(F.struct((-F.col("confidence")).alias("o"), "id"))["id"].alias("canonical_id"))
    return joined.join(best, ["kind", "cluster"]).select("id", "kind", "name", "cluster", "canonical_id")


def link_fuzzy(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, name, cluster): stars of names within two edits of a seed and of at least this similarity."""
    n = rows.select("id", F.lower("name").alias("name"))
    names = stage(n.select("name").distinct(), "names")
    return n.join(stars(names, near_names(names, [], least), []).withColumnRenamed("seed", "cluster"), "name").select("id", "name", "cluster")


def link_hybrid(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, name, cluster, how): names that several rows have are clusters; the rest are linked by edits."""
    n = rows.select("id", F.lower("name").alias("name"))
    counts = stage(n.groupBy("name").agg(F.count("*").alias("n")), "names")
    exact = n.join(counts.where("n > 1"), "name").select("id", "name", F.col("name").alias("cluster"), F.lit("exact").alias("how"))
    return exact.unionByName(link_fuzzy(n.join(counts.where("n = 1"), "name", "left_semi"), least).withColumn("how", F.lit("fuzzy")))


def link_incremental(known: DataFrame, new: DataFrame) -> DataFrame:
    """(id, name, cluster, confidence): new rows join the known cluster (name, cluster) of their name, or found one (.8)."""
    own = F.min("id").over(Window.partitionBy("name"))
    return new.join(known, "name", "left").select("id", "name", F.coalesce("cluster", own).alias("cluster"), F.when(F.col("cluster").isNull(), 0.8).otherwise(1.0).alias("confidence"))


def find_canonical(asked: DataFrame, names: DataFrame, least: float = 0.85) -> DataFrame:
    """(asked, name, score): the equal name but for case, else the most similar one; names meet by deletions."""
    n = names.select("name").distinct().withColumn("rest", F.explode(deletions(F.lower("name"))))
    q = asked.withColumn("rest", F.explode(deletions(F.lower("asked"))))
    pairs = q.join(n, "rest").select("asked", "name").distinct()
    scored = pairs.withColumn("score", F.when(F.lower("asked") == F.lower("name"), 1.0).otherwise(edit_similarity(F.lower("asked"), F.lower("name")))).where(F.col("score") >= least)
    return scored.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("o"), "name", "score")).alias("r")).select("asked", "r.name", F.round("r.score", 6).alias("score"))


def canonical_names(rows: DataFrame) -> DataFrame:
    """(cluster, canonical_name, members) of rows (cluster, name)."""
    n = rows.groupBy("cluster", "name").agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.max_by("name", F.struct(F.col("n"), F.length("name"), F.col("name"))).alias("canonical_name"), F.sum("n").alias("members"))


def merge_clusters(rows: DataFrame, decided: float) -> DataFrame:
    """(cluster, id, name, members, confidence) of clusters of several rows."""
    name = F.max_by("name", F.struct(F.length("name"), F.col("confidence"), -F.col("id")))
    return rows.groupBy("cluster").agg(F.min("id").alias("id"), name.alias("name"), F.count("*").alias("members"), F.round(F.greatest(F.avg("confidence"), F.lit(decided)), 6).alias("confidence")).where("members > 1")


def merge_decisions(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(kind, pairs, mean_similarity, merge) of the distinct names of each kind."""
    n = rows.select("kind", "name").distinct()
    pairs = n.join(n.select("kind", F.col("name").alias("other")), "kind").where("name < other")
    s = tx.name_similarity(F.col("name"), F.col("other"))
    return pairs.groupBy("kind").agg(F.count("*").alias("pairs"), F.round(F.avg(s), 6).alias("mean_similarity"), (F.avg(s) > least).alias("merge"))
