"""Searches of a knowledge graph for many questions at once, and the choice among what they find.

asks: ask_id, name (an entity the question names), vector. Results: ask_id, id, name, score, strategy.

Laws: names are compared without regard to ASCII case; a null name or vector finds nothing by it; scores are rounded to six digits
before they are compared, equal ones stand by id; of several results of one id the best counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vector as vx
from quern.operators.retrieval import batch_search
from quern.runtime import hot_keys, replicate_join, stage

#: What an exact hit scores, and a neighbour's share; what each outgoing edge adds to a central entity's score.
EXACT, NEAR, EDGE = 0.9, 0.7, 0.1
#: Shares of entity, neighbour and community results by the kind of question: entity-focused, of relations, overview, other.
SHARES = {"entity": (0.5, 0.4, 0.1), "relation": (0.3, 0.6, 0.1), "overview": (0.2, 0.2, 0.6), "other": (0.4, 0.4, 0.2)}


def entity_centric(asks: DataFrame, entities: DataFrame, edges: DataFrame, types: DataFrame) -> DataFrame:
    """The entity that is named (.9), and what its edges lead to: .7 x confidence x (1 + cosine of question and relation type).

    types: relation_type, vector. A named hub's edges are dealt out.
    """
    named = entities.select(F.col("id").alias("source"), "name", F.lower("name").alias("low"))
    met = stage(asks.where("name is not null").select("ask_id", F.lower("name").alias("low"), "vector").join(named, "low").select("ask_id", "source", "name", "vector"), "named")
    own = met.select("ask_id", F.col("source").alias("id"), "name", F.lit(EXACT).alias("score"), F.lit("entity").alias("strategy"))
    step = edges.join(F.broadcast(met.select("source").distinct()) if met.count() < 100_000 else met.select("source").distinct(), "source", "left_semi")
    out = replicate_join(step.select("source", "target", "relation_type", "confidence"), met.groupBy("source").agg(F.collect_list(F.struct("ask_id", "vector")).alias("asked")), "source", "target", hot_keys(step, ["source"]))
    each = out.select("target", "relation_type", "confidence", F.explode("asked").alias("a")).select("target", "relation_type", "confidence", "a.ask_id", "a.vector")
    like = each.join(F.broadcast(types.limit(10_000).withColumnRenamed("vector", "of_type")), "relation_type", "left")  # kinds of relations, not relations
    score = F.round(NEAR * F.col("confidence") * (1 + F.coalesce(vx.cosine(F.col("vector"), F.col("of_type")), F.lit(0.0))), 6)
    near = like.groupBy("ask_id", F.col("target").alias("id")).agg(F.max(score).alias("score")).join(entities.select("id", "name"), "id")
    return own.unionByName(near.select("ask_id", "id", "name", "score", F.lit("neighbour").alias("strategy")))


def community_based(asks: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The k entities with the greatest .1 x outgoing edges + cosine with the question; entities: id, name, vector."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    scored = entities.join(out, "id", "left").select("id", "name", "vector", (EDGE * F.coalesce("n", F.lit(0))).alias("bonus"))
    best = batch_search(scored, asks.select(F.col("ask_id").alias("id"), "vector"), "id", "vector", k, bonus="bonus")
    return best.select(F.col("query_id").alias("ask_id"), "id", "score").join(entities.select("id", "name"), "id").select("ask_id", "id", "name", "score", F.lit("community").alias("strategy"))


def first_of(rows: DataFrame, keys: list[str], order: list, spread: str, most: int) -> DataFrame:
    """The first `most` rows of each key; partial ones first, so that no task sorts a hub's rows."""
    for by in ([*keys, F.pmod(F.xxhash64(spread), F.lit(64))], keys):
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= most)
    return rows


def entity_best(asks: DataFrame, entities: DataFrame, edges: DataFrame, types: DataFrame, most: int) -> DataFrame:
    """What entity_centric finds, of which no question's `most` best of each strategy are missing.

    Under one name and relation type a greater confidence never scores less, so the first `most` targets by confidence and id are
    taken once for a name, however many ask it. Rounding may make unlike confidences equal, and then ids decide: where
    the last one taken scores no more than the next confidence would, that question goes through all targets.
    """
    low = F.lower("name").alias("low")
    asked = stage(asks.where("name is not null").select("ask_id", low, "vector"), "asked")
    names = stage(entities.where("name is not null").select(low, F.col("id").alias("source"), "name").join(asked.select("low").distinct(), "low", "left_semi"), "named")
    own = first_of(names, ["low"], ["source"], "source", most).select("low", F.col("source").alias("id"), "name")
    own = asked.select("ask_id", "low").join(own, "low").select("ask_id", "id", "name", F.lit(EXACT).alias("score"), F.lit("entity").alias("strategy"))
    step = edges.select("source", "target", "relation_type", "confidence").join(names.select("source", "low"), "source")
    reached = step.groupBy("low", "relation_type", "target").agg(F.max("confidence").alias("confidence")).join(entities.select(F.col("id").alias("target"), "name"), "target")
    reached = stage(reached, "reached")
    firsts = stage(first_of(reached, ["low", "relation_type"], [F.desc("confidence"), "target"], "target", most), "firsts")
    lists = firsts.groupBy("low", "relation_type").agg(F.min("confidence").alias("last"), F.collect_list(F.struct("target", "name", "confidence")).alias("found"))
    under = reached.join(lists.select("low", "relation_type", "last"), ["low", "relation_type"]).where("confidence < last").groupBy("low", "relation_type").agg(F.max("confidence").alias("next"))
    lists = stage(lists.join(under, ["low", "relation_type"], "left"), "lists")
    like = F.coalesce(vx.cosine(F.col("vector"), F.col("of_type")), F.lit(0.0))
    met = asked.join(lists.join(F.broadcast(types.limit(10_000).withColumnRenamed("vector", "of_type")), "relation_type", "left"), "low")  # kinds of relations, not relations
    met = met.select("ask_id", "low", "relation_type", "last", "next", "found", (1 + like).alias("like"))
    score = lambda c: F.round(NEAR * c * F.col("like"), 6)
    # a weight of fusion may round once more: scores nearer than .0001 count as equal
    all_of = F.coalesce(score(F.col("last")) - score(F.col("next")) < 1e-4, F.lit(False))
    each = met.where(~all_of).select("ask_id", "like", F.explode("found").alias("x")).select("ask_id", F.col("x.target").alias("id"), F.col("x.name").alias("name"), score(F.col("x.confidence")).alias("score"))
    rest = met.where(all_of).select("ask_id", "low", "relation_type", "like").join(reached, ["low", "relation_type"]).select("ask_id", F.col("target").alias("id"), "name", score(F.col("confidence")).alias("score"))
    near = each.unionByName(rest).groupBy("ask_id", "id").agg(F.max_by("name", "score").alias("name"), F.max("score").alias("score"))
    return own.unionByName(near.select("ask_id", "id", "name", "score", F.lit("neighbour").alias("strategy")))


def best_results(results: DataFrame, most: int) -> DataFrame:
    """(ask_id, found): each question's `most` best results (score, id, name), one for each id, the best first; partial tops come first."""
    one = results.groupBy("ask_id", "id").agg(F.max_by("name", "score").alias("name"), F.max("score").alias("score"))
    for keys in (["ask_id", F.pmod(F.xxhash64("id"), F.lit(64))], ["ask_id"]):
        one = one.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rn") <= most)
    return one.groupBy("ask_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id", "name", "score"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["score"].alias("score"))).alias("found"))


def diverse(found: Column, k: int) -> Column:
    """k of some ordered results: those over .8, those of a name not seen yet, any while fewer than k / 2 are taken; then the rest in order."""
    none = F.slice(found, 1, 0)
    new = lambda taken, x: ~F.exists(taken, lambda y: y["name"] == x["name"])
    fits = lambda taken, x: (F.size(taken) < k) & ((x["score"] > 0.8) | new(taken, x) | (F.size(taken) < k // 2))
    first = F.aggregate(found, none, lambda taken, x: F.when(fits(taken, x), F.array_append(taken, x)).otherwise(taken))
    rest = lambda all_, taken: F.filter(all_, lambda x: ~F.exists(taken, lambda y: y["id"] == x["id"]))
    return tx.let(found, lambda a: tx.let(first, lambda taken: F.slice(F.concat(taken, rest(a, taken)), 1, k)))


def adaptive_fusion(results: DataFrame, k: int = 10, pool: int = 200) -> DataFrame:
    """(ask_id, place, id, score): k diverse results of each question, out of its `pool` best."""
    chosen = best_results(results, pool).select("ask_id", F.posexplode(diverse(F.col("found"), k)).alias("place", "x"))
    return chosen.select("ask_id", "place", "x.id", "x.score")


def execute_adaptive(asks: DataFrame, entities: DataFrame, edges: DataFrame, types: DataFrame, kind: str = "entity", k: int = 10, pool: int = 200) -> DataFrame:
    """(ask_id, place, id, score): all searches, weighted by the kind of question, fused."""
    entity, near, community = SHARES[kind]
    weighted = lambda df, w: df.withColumn("score", F.round(F.col("score") * w, 6))
    own = stage(entity_best(asks, entities, edges, types, pool), "entity-centric")
    parts = weighted(own.where("strategy = 'entity'"), entity).unionByName(weighted(own.where("strategy = 'neighbour'"), near))
    return adaptive_fusion(parts.unionByName(weighted(community_based(asks, entities, edges), community)), k, pool)


def hierarchical(found: DataFrame, detail: str = "detailed") -> DataFrame:
    """Each tree's best summaries (tree, id, score): 3 for an overview, 8 in detail, else 5; with a bonus of .3, .2 or 0."""
    k, bonus = {"overview": (3, 0.3), "detailed": (8, 0.2)}.get(detail, (5, 0.0))
    w = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("score", F.round(F.col("score") + bonus, 6))
