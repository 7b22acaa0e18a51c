"""Lexical and vector retrieval, and the fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vector as vx
from quern.operators import graph
from quern.runtime import stage


class Index:
    """A lexical index, staged: postings (key, term, n, length) and each document's length.

    Texts are tokenised once, in build; searches read postings of their terms alone. The postings lie in files
    sorted by term, so that a term's are skipped to.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, key: str):
        self.postings, self.lengths, self.key = postings, lengths, key

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
        tokens = docs.select(key, tx.index_tokens(F.col(text)).alias("tokens"))
        lengths = stage(tokens.select(key, F.size("tokens").alias("length"), "tokens"), "tokens")
        each = lengths.select(key, "length", F.explode("tokens").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("n"))
        return cls(stage(each.sortWithinPartitions("term"), "postings"), lengths.select(key, "length"), key)

    def terms(self) -> DataFrame:
        """(term, n, df)."""
        return self.postings.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))

    def stats(self) -> DataFrame:
        """(documents, mean_length, terms) as one row."""
        of = self.lengths.agg(F.count("*").alias("documents"), F.round(F.avg("length"), 6).alias("mean_length"))
        return of.join(self.postings.agg(F.countDistinct("term").alias("terms")))

    def search(self, terms: list[str], k: int | None = 10, **rules) -> DataFrame:
        hits = self.postings.where(F.col("term").isin(list(dict.fromkeys(terms)))).select(self.key, "length", "term", "n")
        return scored(hits, self.lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length")), terms, self.key, k, **rules)


def scored(hits: DataFrame, stats: DataFrame, terms: list[str], key: str, k: int | None, k1: float = 1.2, b: float = 0.75, standard_tf: bool = False) -> DataFrame:
    """Scores of postings (key, length, term, n) of query terms, the best k, ties by key.

    By default term frequency is divided by the document's length, as the engine's contract has it;
    standard_tf takes the plain count. A repeated query term counts again.
    """
    wanted = {t: terms.count(t) for t in terms}
    one = stats.collect()[0]
    if not one["documents"] or not one["mean_length"] or not wanted:
        return hits.select(key, F.lit(0.0).alias("score")).limit(0)
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each query term
    weight = F.lit(0.0)
    for t, n in wanted.items():
        if t in df:
            weight = F.when(F.col("term") == t, F.lit(float(n)) * (F.log(F.lit(one["documents"] / df[t])) + 1)).otherwise(weight)
    tf = F.col("n").cast("double") if standard_tf else F.col("n") / F.col("length")
    score = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(one["mean_length"])))
    ranked = hits.groupBy(key).agg(F.round(F.sum(score), 6).alias("score"))
    return ranked if k is None else ranked.orderBy(F.desc("score"), key).limit(k)


def bm25_search(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k: int | None = 10, **rules) -> DataFrame:
    """A search without an index: one pass tokenises the texts and keeps each one's length and hits, staged."""
    tokens = docs.select(key, tx.index_tokens(F.col(text)).alias("tokens"))
    own = stage(tokens.select(key, F.size("tokens").alias("length"), F.filter("tokens", lambda w: w.isin(list(dict.fromkeys(terms)))).alias("hits")), "lengths")
    hits = own.select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("n"))
    return scored(hits, own.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length")), terms, key, k, **rules)


def vector_search(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", k: int | None = 10, least: float | None = None) -> DataFrame:
    """Exact cosine search for one query vector, a literal, so nothing is shuffled but the best k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(vx.cosine(F.col(vector), q), 6).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def usable(vectors: DataFrame, key: str, vector: str, width: int | None = None, keep: list[str] = []) -> tuple[DataFrame, int]:
    """Rows with an id and a vector of the most common width (or the given one) without nulls, and that width; others take no part."""
    own = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    if width is None:
        width = own.agg(F.mode(F.size(vector), deterministic=True)).collect()[0][0] or 0
    return own.where(F.size(vector) == width).select(key, vector, *keep), width


def block_search(key: str, vector: str, k: int):
    """A function of some rows (key, vector, _bonus) and some queries (key, vector), pandas tables, that gives the k nearest others of each query."""
    import numpy as np
    import pandas as pd

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": some[key][:0], key: own[key][:0], "score": np.zeros(0)})]
        if len(own) and len(some):
            own = own.sort_values(key)
            keys, x, added = own[key].to_numpy(), unit(own[vector]).T, own["_bonus"].to_numpy()
            for i in range(0, len(some), 256):
                ids = some[key].to_numpy()[i : i + 256]
                sims = np.round(unit(some[vector][i : i + 256]) @ x + added, 6)
                begin, end = np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")
                most = k + int((end - begin).max())  # a query's own rows are taken out below
                near = np.ones(sims.shape, bool)
                if most < len(keys):
                    least = -np.partition(-sims, most - 1, axis=1)[:, most - 1 : most]
                    near = (sims >= least) | np.isnan(least)
                at, to = np.nonzero(near)
                others = (to < begin[at]) | (to >= end[at])
                at, to = at[others], to[others]
                order = np.lexsort((to, -sims[at, to], at))
                at, to = at[order], to[order]
                first = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
                at, to = at[first], to[first]
                out.append(pd.DataFrame({"query_id": ids[at], key: keys[to], "score": sims[at, to]}))
        return pd.concat(out[1:] or out)

    return best


def batch_search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 16_384, part: int = 16_384, bonus: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k nearest others of each query. Parts of the vectors meet blocks of the queries, each pair
    in a task of its own by matrix products of some queries at a time, and keep k of each query; the plan is the same whatever the number of queries.

    bonus: a column of numbers that are added to a vector's likeness. A likeness lies between -1 and 1, so rows whose bonus is more than 2 below
    that of k + 1 others can't be found and are left out before anything is compared. Rows without an id or a vector, with a null in it or of another
    width than most take no part; a zero vector is like none (0).
    """
    more = F.lit(0.0) if bonus is None else F.coalesce(F.col(bonus), F.lit(0.0))
    index, width = usable(vectors.withColumn("_bonus", more), key, vector, keep=["_bonus"])
    asked, _ = usable(queries, key, vector, width)
    if bonus is not None:
        index = stage(index, "with-bonus")
        least = [r[0] for r in index.groupBy(key).agg(F.max("_bonus").alias("m")).orderBy(F.desc("m")).limit(k + 1).select("m").collect()]
        if len(least) > k and least[-1] == least[-1]:
            index = index.where(F.col("_bonus") >= least[-1] - 2.00001 - 1e-9 * abs(least[-1]))
    rows, asks = index.count(), asked.count()
    parts, blocks = max(1, -(-rows // part)), max(1, -(-asks // block))
    while parts * blocks < 48 and (rows // parts) * (asks // blocks) > 1 << 18:  # tasks for all cores
        parts, blocks = (2 * parts, blocks) if rows // parts > asks // blocks else (parts, 2 * blocks)
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("p", place(parts)).withColumn("b", every(blocks))
    right = asked.withColumn("b", place(blocks)).withColumn("p", every(parts))

    best = block_search(key, vector, k)
    kind = vectors.schema[key].dataType.simpleString()
    found = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInPandas(best, f"query_id {kind}, {key} {kind}, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def sample_of(vectors: DataFrame, vector: str, key: str, most: int):
    """At most `most` vectors, those of the least hashes, to unit length."""
    import numpy as np

    rows = vectors.select(vector).orderBy(F.xxhash64(key), key).limit(most).collect()
    x = np.array([r[0] for r in rows], np.float32).reshape(len(rows), len(rows[0][0]) if rows else 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(x, cells: int, rounds: int = 8):
    """Unit centroids of cells, by k-means over some unit vectors."""
    import numpy as np

    c = x[:: max(1, len(x) // max(1, cells))][:cells].copy()
    for _ in range(rounds if len(c) else 0):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(c)) > 0
        c[held] = sums[held]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def probes_for(x, c, k: int, recall: float, queries: int = 512) -> int:
    """In how many nearest cells a query must look to meet this share of its k nearest: measured by brute force on a sample.

    A sample is thinner than the index, so its neighbours are farther and the answer errs to the safe side.
    """
    import numpy as np

    q = x[:: max(1, len(x) // queries)][:queries]
    if len(x) <= k or not len(c):
        return max(1, len(c))
    sims = q @ x.T
    sims[np.arange(len(q)), np.arange(len(q)) * max(1, len(x) // queries)] = -2
    near = np.argpartition(-sims, k, axis=1)[:, :k]
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None].repeat(len(q), axis=0), axis=1)
    at = np.sort(np.take_along_axis(place, (x @ c.T).argmax(axis=1)[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(len(at) * recall)))]) + 1


def in_cells(vectors: DataFrame, c, key: str, vector: str, cells: int) -> DataFrame:
    """(key, vector, cell): each vector with its nearest cells, one row for each."""
    import numpy as np
    import pandas as pd

    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.array(batch[vector].tolist(), np.float32)
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :cells]
                yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), near.shape[1]), vector: [v for v in batch[vector] for _ in range(near.shape[1])], "cell": near.ravel().astype("int32")})

    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"{key} {vectors.schema[key].dataType.simpleString()}, {vector} array<float>, cell int")


def vector_ann(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, cells: int | None = None, probes: int | None = None, recall: float = 0.95, sample: int = 32_768, part: int = 16_384) -> DataFrame:
    """(query_id, key, score, rank): the nearest others of each query, approximately: every vector is indexed in the
    cell of its nearest centroid, a query looks in its `probes` nearest cells and compares exactly there.

    By default there are about as many cells as the root of the vectors (16 to 1,024), and probes are as many as the sample needs for
    the recall. Which rows take part is as in batch_search. A cell of more than `part` vectors is dealt to several tasks, which compare
    by matrix products.
    """
    index, width = usable(vectors, key, vector)
    asked, _ = usable(queries, key, vector, width)
    x = sample_of(index, vector, key, sample)
    c = centroids(x, cells or min(1024, max(16, int(index.count() ** 0.5))))
    index = in_cells(index, c, key, vector, 1)
    asked = in_cells(asked, c, key, vector, probes or probes_for(x, c, k, recall))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("n"))  # a row for each cell
    kind, parts = vectors.schema[key].dataType.simpleString(), F.broadcast(stage(parts, "cells"))
    index = index.join(parts, "cell").withColumn("p", F.pmod(F.xxhash64(key), F.col("n")).cast("int")).select("cell", "p", key, vector, F.lit(0.0).alias("_bonus"))
    asked = asked.join(parts, "cell").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("cell", "p", key, vector)
    near = index.groupBy("cell", "p").cogroup(asked.groupBy("cell", "p")).applyInPandas(block_search(key, vector, k), f"query_id {kind}, {key} {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def group_pairs(vectors: DataFrame, group: str | None, key: str, vector: str, least: float, part: int = 4096) -> DataFrame:
    """(a, b, score): every pair a < b of one group (None: of all) with a cosine over `least` (0 or more), by matrix products.

    A group's rows are dealt into parts, and each pair of parts is a task's; so no task holds more than two parts, whatever a
    group's size. The pairs themselves grow with its square. Vectors of different lengths are no pair.
    """
    import numpy as np
    import pandas as pd

    known = F.lit(True) if group is None else F.col(group).isNotNull()
    own = vectors.where(known & F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    own = own.select(F.struct(*([] if group is None else [F.col(group)]), F.size(vector)).alias("g"), F.col(key).alias("id"), F.col(vector).alias("x"))
    sizes = F.broadcast(stage(own.groupBy("g").agg(F.ceil(F.count("*") / part).cast("int").alias("n")), "group-sizes"))
    own = own.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    side = lambda n: [F.col("g").alias(f"g{n}"), F.col("id").alias(f"id{n}"), F.col("x").alias(f"x{n}")]
    left = own.select(*side(1), F.col("p").alias("i"), F.explode(F.sequence(F.col("p"), F.col("n") - 1)).alias("j"))
    right = own.select(*side(2), F.explode(F.sequence(F.lit(0), F.col("p"))).alias("i"), F.col("p").alias("j"))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), np.float64).reshape(len(x), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def pairs(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": some["id1"][:0], "b": some["id1"][:0], "score": np.zeros(0)})]
        if len(some) and len(others):
            same = some["i"].iloc[0] == some["j"].iloc[0]
            ids, to, y = some["id1"].to_numpy(), others["id2"].to_numpy(), unit(others["x2"]).T
            for k in range(0, len(some), 256):
                sims = unit(some["x1"][k : k + 256]) @ y
                at, col = np.nonzero((sims > least - 1e-6) | np.isnan(sims))
                score = np.round(sims[at, col], 6)
                near = (score > least) | np.isnan(score)
                p, q, score = ids[k + at[near]], to[col[near]], score[near]
                keep = p < q if same else p != q
                out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "score": score[keep]}))
        return pd.concat(out[1:] or out)

    kind = vectors.schema[key].dataType.simpleString()
    return left.groupBy("g1", "i", "j").cogroup(right.groupBy("g2", "i", "j")).applyInPandas(pairs, f"a {kind}, b {kind}, score double")


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, k: int) -> DataFrame:
    """Edges SEMANTICALLY_SIMILAR: each vector's best k others above `least`."""
    return batch_search(vectors, vectors, key, vector, k).where(F.col("score") > least)


def ranked(df: DataFrame, key: str, score: str = "score") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def fuse(lists: list[DataFrame], weights: list[float], how: str, key: str = "id", k: int | None = 10, constant: int = 60) -> DataFrame:
    """Fuses short ranked lists (key, score): rrf, weighted (by each list's maximum), combsum or max."""
    parts = []
    for df, w in zip(lists, weights):
        one = df.select(key, "score")
        if how == "rrf":
            one = ranked(one, key).select(key, (F.lit(w) / (constant + F.col("rank") + 1)).alias("score"))
        elif how == "weighted":
            top = F.max("score").over(Window.partitionBy(F.lit(1)))
            one = one.select(key, (F.lit(w) * F.when(top > 0, F.col("score") / top).otherwise(0.0)).alias("score"))
        parts.append(one)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    agg = F.max("score") if how == "max" else F.sum("score")
    fused = every.groupBy(key).agg(F.round(agg, 6).alias("score"))
    return fused if k is None else fused.orderBy(F.desc("score"), key).limit(k)


def best_per_id(df: DataFrame, key: str, score: str = "score") -> DataFrame:
    """The row of highest score for each key."""
    w = Window.partitionBy(key).orderBy(F.desc(score))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def interleave(high: DataFrame, low: DataFrame, key: str = "id") -> DataFrame:
    """Alternates two ranked lists, high first; an id keeps its first place."""
    h = ranked(high, key).select(key, "score", (F.col("rank") * 2).alias("place"))
    low_ = ranked(low, key).select(key, "score", (F.col("rank") * 2 + 1).alias("place"))
    first = Window.partitionBy(key).orderBy("place")
    return h.unionByName(low_).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def pagerank_retrieval(entities: DataFrame, edges: DataFrame, question: str, k: int = 10, least: float = 0.1) -> DataFrame:
    """(node, rank): the best of PageRank seeded by the words that a question shares with an entity's name and type."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(question.lower().split())])
    own = tx.words(F.lower(F.concat_ws(" ", "name", "entity_type")))
    seeds = entities.select("id", tx.jaccard(own, asked).alias("p")).where(F.col("p") > least)
    return graph.pagerank(entities.select("id"), edges, seeds).select("node", F.round("rank", 8).alias("rank")).orderBy(F.desc("rank"), "node").limit(k)


def min_max(df: DataFrame, value: str) -> DataFrame:
    """Scales a column to 0 to 1; all 1 where all are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(F.broadcast(ends)).withColumn(value, F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def hipporag(nodes: DataFrame, edges: DataFrame, facts: DataFrame, passages: DataFrame, passages_of: DataFrame, k: int = 10, passage_weight: float = 0.05, damping: float = 0.5) -> DataFrame:
    """(node, score) of passages by PageRank from the entities of facts and the passages' own scores.

    facts (source, target, score): an entity weighs the mean of its facts' scores by the number of passages that
    have it (passages_of: id, n); both kinds of weight are scaled to 0 to 1, then summed and normalised.
    """
    ends = facts.select("score", F.explode(F.array("source", "target")).alias("id")).join(passages_of, "id", "left")
    entity = ends.groupBy("id").agg(F.avg(F.col("score") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("p"))
    passage = passages.select("id", (F.col("score") * passage_weight).alias("p"))
    seeds = min_max(entity, "p").unionByName(min_max(passage, "p")).groupBy("id").agg(F.sum("p").alias("p"))
    ranks = graph.pagerank(nodes, edges, seeds, damping=damping)
    return ranks.join(F.broadcast(passages.select(F.col("id").alias("node"))), "node", "left_semi").select("node", F.round("rank", 8).alias("score")).orderBy(F.desc("score"), "node").limit(k)


def entity_paths(direct: DataFrame, shared: DataFrame) -> DataFrame:
    """(source, other, score, how): direct edges .8 x confidence; sources with a common target .6 x both confidences."""
    one = direct.select("source", F.col("target").alias("other"), F.round(0.8 * F.col("confidence"), 6).alias("score"), F.lit("direct").alias("how"))
    b = shared.select(F.col("source").alias("other"), "target", F.col("confidence").alias("c2"))
    two = shared.join(b, "target").where("source < other").select("source", "other", F.round(0.6 * F.col("confidence") * F.col("c2"), 6).alias("score"), F.lit("common").alias("how"))
    return one.union(two)


def symbolic_anchors(concepts: list[str], entities: DataFrame, edges: DataFrame, most: int = 10, least: float = 0.3, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(concept, n, relevance) of the best concepts, and (id, relevance) of the entities that ground them.

    A concept is grounded by at most `most` entities, the first by id, whose name or whose outgoing types hold it.
    """
    c = entities.sparkSession.createDataFrame([(x,) for x in concepts], "concept string")
    by_name = entities.join(F.broadcast(c), F.contains(F.lower("name"), F.col("concept"))).select("concept", "id", "confidence")
    kinds = edges.select("source", "relation_type").distinct().join(F.broadcast(c), F.contains(F.lower("relation_type"), F.col("concept"))).select("concept", F.col("source").alias("id")).distinct()
    hits = by_name.union(kinds.join(entities.select("id", "confidence"), "id").select("concept", "id", "confidence")).distinct()
    first = hits.withColumn("rn", F.row_number().over(Window.partitionBy("concept").orderBy("id"))).where(F.col("rn") <= most)
    relevance = F.round(0.4 * F.least(F.count("*") / 10.0, F.lit(1.0)) + 0.6 * F.avg("confidence"), 6)
    best = first.groupBy("concept").agg(F.count("*").alias("n"), relevance.alias("relevance")).where(F.col("relevance") >= least).orderBy(F.desc("relevance"), "concept").limit(k)
    return best, first.join(F.broadcast(best.select("concept", "relevance")), "concept").select("id", "relevance")


def anchor_boost(results: DataFrame, entities_of: DataFrame, grounded: DataFrame) -> DataFrame:
    """(id, score): scores raised by the mean relevance of the anchors of a result's entities (id, entity)."""
    own = grounded.groupBy(F.col("id").alias("entity")).agg(F.avg("relevance").alias("b"))
    boost = entities_of.join(F.broadcast(own), "entity").groupBy("id").agg(F.avg("b").alias("boost"))
    return results.join(boost, "id", "left").select("id", F.round(F.col("score") * (1 + F.coalesce("boost", F.lit(0.0))), 6).alias("score"))


def finalise(fused: DataFrame, least: float = 0.1, k: int = 10) -> DataFrame:
    """(id, score, kind): scores of at least .1, the type by the id's prefix, the best k."""
    kind = F.when(F.col("id").startswith("entity:"), "Entity").when(F.col("id").startswith("chunk:"), "Chunk").otherwise("Hybrid")
    return fused.where(F.col("score") >= least).withColumn("kind", kind).orderBy(F.desc("score"), "id").limit(k)


def cross_strategy(results: DataFrame) -> DataFrame:
    """(signature, kinds, score): contents that several result types found, by their first 50 characters."""
    g = results.groupBy(F.substring("content", 1, 50).alias("signature")).agg(F.countDistinct("kind").alias("kinds"), F.avg("score").alias("s")).where("kinds > 1")
    return g.select("signature", "kinds", F.round(F.least(F.lit(1.0), F.col("s") + 0.2 * (F.col("kinds") - 1)), 6).alias("score"))


def adaptive_rank(results: DataFrame, key_names: list[str], k: int = 30) -> DataFrame:
    """(id, kind, score, place): boosts by type and by each key name in the content, one row for a content's first 50
    characters and length, then a quota for each type: k / 3, k / 2, k / 4, k / 4 and k / 5."""
    boosts = {"Entity": 1.2, "GraphPath": 1.1, "Hybrid": 1.15}
    quotas = {"Entity": k // 3, "Chunk": k // 2, "GraphPath": k // 4, "HierarchicalSummary": k // 4, "Hybrid": k // 5}
    low = F.lower("content")
    hits = sum((F.contains(low, F.lit(n)).cast("int") for n in dict.fromkeys(n.lower() for n in key_names)), F.lit(0))
    score = F.col("score") * F.lit(1.0)
    for kind, b in boosts.items():
        score = F.when(F.col("kind") == kind, F.col("score") * b).otherwise(score)
    r = results.select("id", "kind", "content", F.round(score * F.pow(F.lit(1.1), hits), 6).alias("score"))
    first = Window.partitionBy(F.substring("content", 1, 50), F.length("content")).orderBy(F.desc("score"), "id")
    r = r.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    quota = F.lit(0)
    for kind, n in quotas.items():
        quota = F.when(F.col("kind") == kind, n).otherwise(quota)
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id")).cast("long"))
    return r.where(F.col("place") <= quota).select("id", "kind", "score", "place")


def context(results: DataFrame, summaries: DataFrame, most: int = 10) -> DataFrame:
    """(part, id, score, place): primary (chunks and entities of .7), supporting (.3) and summaries, half of `most` each and three."""
    part = F.when((F.col("score") >= 0.7) & F.col("kind").isin("Chunk", "Entity"), "primary").when(F.col("score") >= 0.3, "supporting")
    rows = results.withColumn("part", part).where("part is not null").select("part", "id", "score").union(summaries.select(F.lit("summary"), "id", "score"))
    w = Window.partitionBy("part").orderBy(F.desc("score"), "id")
    limit = F.when(F.col("part") == "summary", 3).otherwise(most // 2)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit)


def context_confidence(parts: DataFrame) -> DataFrame:
    """One row: .5 x the mean of the primary, .3 x of the supporting, .2 x of the summaries, at most 1."""
    mean = lambda p: F.coalesce(F.avg(F.when(F.col("part") == p, F.col("score"))), F.lit(0.0))
    return parts.agg(F.round(F.least(F.lit(1.0), 0.5 * mean("primary") + 0.3 * mean("supporting") + 0.2 * mean("summary")), 6).alias("confidence"), F.count("*").alias("sources"))


def answer_confidence(base, answer, names: list[str]):
    """Less for short (.7) and negative (.5) answers, more (.1 each, .2 at most) for names that the answer has."""
    low = F.lower(answer)
    hits = sum((F.contains(low, F.lit(n.lower())).cast("int") for n in names), F.lit(0))
    c = base * F.when(F.octet_length(answer) < 20, 0.7).otherwise(1.0) * F.when(F.contains(answer, F.lit("No relevant")) | F.contains(answer, F.lit("insufficient")), 0.5).otherwise(1.0)
    return F.round(F.least(F.lit(1.0), c + F.least(F.lit(0.2), 0.1 * hits)), 6)


def multimodal(vector: DataFrame, rank: DataFrame, vector_weight: float = 0.3, rank_weight: float = 0.4) -> DataFrame:
    """(id, score): .3 x vector score + .4 x PageRank; what either lacks counts 0."""
    both = vector.select("id", F.col("score").alias("v")).join(rank.select("id", F.col("score").alias("p")), "id", "full")
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(18,6)") * F.lit(w).cast("decimal(4,2)")  # noqa: E731  exact, so that halves round alike
    return both.select("id", F.round(part("v", vector_weight) + part("p", rank_weight), 6).cast("double").alias("score"))
