"""Graph operators on edges (source, target, ...). Iterative ones stage each round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vector as vx
from quern.operators.push import shares, weighted
from quern.runtime import stage

#: Levels of nodes that no cycle leads to which PageRank takes out before its rounds.
LEVELS = 4


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs in both directions, without loops."""
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.where("source <> target").distinct()


def neighbours_out(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges, several edges count several times."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.count()
    joined = nodes.select(F.col("id").alias("node")).join(degrees(edges), "node", "left")
    return joined.select("node", F.round(F.coalesce("degree", F.lit(0)) / F.lit(max(1, n - 1)), 6).alias("centrality"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    e = edges.agg(F.count("*").alias("e"))
    return n.join(e).select("n", "e", F.round(F.when(F.col("n") > 1, 2.0 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 9).alias("density"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(node, triangles) of distinct neighbour pairs in both directions. Edges lead to the end of more neighbours; a triangle is
    found once, by the two edges of such a path through its middle node, so a hub, to which edges only lead, makes none."""
    d = pairs.groupBy("source").agg(F.count("*").alias("d"))
    rank = lambda side: d.select(F.col("source").alias(side), F.struct("d", "source").alias(f"r_{side}"))
    once = pairs.where("source < target").join(rank("source"), "source").join(rank("target"), "target")
    low = F.col("r_source") < F.col("r_target")
    up = stage(once.select(F.when(low, F.col("source")).otherwise(F.col("target")).alias("source"), F.when(low, F.col("target")).otherwise(F.col("source")).alias("target")), "up")
    onward = up.select(F.col("source").alias("b"), F.col("target").alias("c"))
    through = stage(onward.select("b").distinct(), "middle")
    into = up.select("source", F.col("target").alias("b")).join(through, "b", "left_semi")
    closed = into.join(onward, "b").join(up.select("source", F.col("target").alias("c")), ["source", "c"])
    return closed.select(F.explode(F.array("source", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, neighbours, coefficient) of nodes with two neighbours or more, on distinct undirected edges."""
    pairs = stage(undirected(edges), "pairs")
    k = pairs.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("neighbours")).where("neighbours >= 2")
    t = k.join(triangles(pairs), "node", "left")
    return t.select("node", "neighbours", F.round(2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("neighbours") * (F.col("neighbours") - 1)), 6).alias("coefficient"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance) within `depth` undirected hops of any seed, least distance of several."""
    ends = edges.select("source", "target")
    both = ends.union(ends.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target")
    seen = stage(seeds.select(F.col("id").alias("node")).distinct().withColumn("distance", F.lit(0)), "bfs")
    for d in range(1, depth + 1):
        front = seen.where(F.col("distance") == d - 1)
        new = both.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()  # only what is met is made distinct
        new = new.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        seen = stage(seen.unionByName(new), "bfs")
    return seen


def ego_network(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The edges between nodes within `hops` of the seeds."""
    near = bfs(edges, seeds, hops).select("node")
    return edges.join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi")


def simple_paths(edges: DataFrame, starts: DataFrame, most_nodes: int, weight: str = "confidence") -> DataFrame:
    """(start, node, path, weight, hops): simple directed paths of at most `most_nodes` nodes."""
    step = edges.select("source", F.col("target").alias("next"), F.col(weight).alias("w"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0.0).alias("weight"), F.lit(0).alias("hops"))
    every = None
    for _ in range(most_nodes - 1):
        grown = now.join(step, now["node"] == step["source"]).where(~F.array_contains("path", F.col("next")))
        now = stage(grown.select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("hops") + 1).alias("hops")), "paths")
        every = now if every is None else every.unionByName(now)
    return every


def hop_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, distance, path): directed paths of fewest edges from any start, the least of equals, within `depth`."""
    step = edges.select("source", F.col("target").alias("next")).distinct()
    seen = stage(starts.select(F.col("id").alias("node"), F.lit(0).alias("distance"), F.array("id").alias("path")), "hops")
    for d in range(1, depth + 1):
        front = seen.where(F.col("distance") == d - 1)
        new = front.join(step, front["node"] == step["source"]).groupBy(F.col("next").alias("node")).agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        seen = stage(seen.unionByName(new.join(seen, "node", "left_anti").select("node", F.lit(d).alias("distance"), "path")), "hops")
    return seen


def shortest_paths(edges: DataFrame, starts: DataFrame, most_rounds: int = 200, weight: str = "confidence") -> DataFrame:
    """(start, node, distance, path) of all starts (id) at once, by undirected relaxation until nothing changes; ties by path.

    Each round joins only what the last one improved. Raises if `most_rounds` don't suffice.
    """
    step = edges.select("source", "target", F.col(weight).alias("w"))
    step = stage(step.union(step.select("target", "source", "w")).where("source <> target").groupBy("source", "target").agg(F.min("w").alias("w")), "steps")
    best = stage(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("distance"), F.array("id").alias("path"), F.lit(True).alias("new")), "shortest")
    for _ in range(most_rounds):
        front = best.where("new").drop("new")
        grown = front.join(step, front["node"] == step["source"]).select("start", F.col("target").alias("node"), F.round(F.col("distance") + F.col("w"), 9).alias("distance"), F.array_append("path", F.col("target")).alias("path"), F.lit(True).alias("new"))
        both = grown.unionByName(best.withColumn("new", F.lit(False)))
        best = stage(both.groupBy("start", "node").agg(F.min(F.struct("distance", "path", "new")).alias("b")).select("start", "node", "b.distance", "b.path", "b.new"), "shortest")
        if best.where("new").isEmpty():
            return best.drop("new")
    raise RuntimeError("shortest paths did not settle")


def closeness(paths: DataFrame) -> DataFrame:
    """(node, reachable, closeness): reached nodes by the sum of their distances, of shortest_paths()."""
    p = paths.where("distance > 0").groupBy(F.col("start").alias("node"))
    return p.agg(F.count("*").alias("reachable"), F.round(F.count("*") / F.sum("distance"), 6).alias("closeness"))


def betweenness(paths: DataFrame) -> DataFrame:
    """(node, paths, betweenness): ordered pairs whose shortest path runs through a node, by (n - 1)(n - 2) / 2."""
    n = paths.select("node").distinct().count()
    inner = paths.where("size(path) > 2").select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node"))
    return inner.groupBy("node").agg(F.count("*").alias("paths")).withColumn("betweenness", F.round(F.col("paths") / F.lit(max(1.0, (n - 1) * (n - 2) / 2)), 6))


class Stripped:
    """A graph without its trees, for sums over all pairs: a node with one neighbour left is taken off, round by round, and
    passes on how many nodes hang on it and how far they are together; paths are sought between what remains (the core).

    hung: node, up (null in the core), w, m (nodes that hang on it, itself too), far (the sum of their distances), squares
    (of its branches' sizes), off (the round it was taken off in). paths: start, node, distance, path of the core.
    Costs must be above 0, as all other shortest paths of a pair are sought too. At most `most_rounds` rounds are made;
    trees that are deeper stay in the core, which costs pairs, never results.
    """

    def __init__(self, edges: DataFrame, weight: str = "confidence", most_rounds: int = 30):
        step = edges.select("source", "target", F.col(weight).alias("w"))
        left = stage(step.union(step.select("target", "source", "w")).where("source <> target").groupBy("source", "target").agg(F.min("w").alias("w")), "steps")
        if not left.where("w <= 0").isEmpty():
            raise ValueError("costs must be above 0")
        ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()
        held = stage(ends.select("node", F.lit(1).cast("long").alias("m"), F.lit(0.0).alias("far"), F.lit(0).cast("long").alias("squares")), "held")
        self.off = []
        for _ in range(most_rounds):
            one = left.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("up"), F.min("w").alias("w")).where("n = 1").drop("n")
            back = one.select(F.col("node").alias("up"), F.col("up").alias("back"))
            mine = stage(one.join(back, "up", "left").where(F.col("back").isNull() | (F.col("node") > F.col("up"))).select("node", "up", "w"), "ends")  # of two alone the least stays
            if mine.isEmpty():
                break
            gone = stage(held.join(mine, "node"), "off")
            add = gone.groupBy(F.col("up").alias("node")).agg(F.sum("m").alias("am"), F.sum(F.col("far") + F.col("w") * F.col("m")).alias("af"), F.sum(F.col("m") * F.col("m")).alias("aq"))
            names = mine.select("node")
            held = stage(held.join(names, "node", "left_anti").join(add, "node", "left").na.fill(0, ["am", "aq"]).na.fill(0.0, ["af"]).select("node", (F.col("m") + F.col("am")).alias("m"), (F.col("far") + F.col("af")).alias("far"), (F.col("squares") + F.col("aq")).alias("squares")), "held")
            left = stage(left.join(names.withColumnRenamed("node", "source"), "source", "left_anti").join(names.withColumnRenamed("node", "target"), "target", "left_anti"), "steps")
            self.off.append(gone)
        self.core = held
        self.paths = stage(shortest_paths(left.where("source < target"), held.select(F.col("node").alias("id")), weight="w"), "core-paths")
        to = held.select("node", F.col("m").alias("m_to"), F.col("far").alias("far_to"))
        around = self.paths.join(to, "node").groupBy(F.col("start").alias("node")).agg(F.sum("m_to").alias("size"), F.sum(F.col("m_to") * F.col("distance") + F.col("far_to")).alias("sum"))
        now = stage(held.join(around, "node"), "summed")
        every = now
        for gone in reversed(self.off):
            up = every.select(F.col("node").alias("up"), "size", F.col("sum").alias("sum_up"))
            own = gone.join(up, "up").select("node", "m", "far", "squares", "size", (F.col("sum_up") + F.col("w") * (F.col("size") - 2 * F.col("m"))).alias("sum"))
            every = stage(every.unionByName(own), "summed")
        #: node, m, far, squares, size (nodes of its component), sum (of its distances to all of them)
        self.sums = every


def closeness_of_all(edges: DataFrame, weight: str = "confidence") -> DataFrame:
    """(node, reachable, closeness): reached nodes by the sum of their distances along shortest undirected paths."""
    s = Stripped(edges, weight).sums.where("size > 1")
    return s.select("node", (F.col("size") - 1).alias("reachable"), F.round((F.col("size") - 1) / F.col("sum"), 6).alias("closeness"))


def betweenness_of_all(edges: DataFrame, weight: str = "confidence") -> DataFrame:
    """(node, paths, betweenness): ordered pairs whose shortest path runs through a node, by (n - 1)(n - 2) / 2."""
    g = Stripped(edges, weight)
    n = g.sums.count()
    m = g.core.select("node", F.col("m").alias("m_end"))
    inner = g.paths.where("size(path) > 2").join(m.withColumnsRenamed({"node": "start", "m_end": "m_start"}), "start").join(m, "node")
    inner = inner.select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node"), (F.col("m_start") * F.col("m_end")).alias("pairs")).groupBy("node").agg(F.sum("pairs").alias("through"))
    # pairs of two branches that hang on a node, pairs of one and of what doesn't hang on it, pairs of the core that pass it
    own = (F.col("m") - 1) * (F.col("m") - 1) - F.col("squares") + 2 * (F.col("m") - 1) * (F.col("size") - F.col("m")) + F.coalesce("through", F.lit(0))
    counted = g.sums.join(inner, "node", "left").select("node", own.alias("paths")).where("paths > 0")
    return counted.withColumn("betweenness", F.round(F.col("paths") / F.lit(max(1.0, (n - 1) * (n - 2) / 2)), 6))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 100, damping: float = 0.85, weight: str = "confidence", tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): personalised PageRank, weights normalised by source, dangling mass spread by the seed vector.

    seeds (id, p) are normalised to sum 1; without them every node is one. Rounds end once no rank moves by
    the tolerance. Edges with a null end or a weight that isn't above 0 are none.

    A node without incoming edges always has its seed times one number c of the round. So has, of the rounds before, what it
    sends, and what a node sends that only such nodes lead to; these are taken out, level by level (at most LEVELS), with
    what they pass on: their rank is the sum of c(i - j) x damping^j x f_j, f_0 being the seed and f_j what arrives in j
    steps. Rounds run over the rest, nodes on cycles and behind them, and sums of f_j tell what the others lose.
    """
    base = nodes.select(F.col("id").alias("node"))
    if seeds is None:
        start = base.withColumn("r", F.lit(1.0 / max(1, base.count())))
    else:
        total = seeds.agg(F.sum("p")).collect()[0][0] or 1.0
        start = base.join(seeds.groupBy(F.col("id").alias("node")).agg((F.sum("p") / F.lit(total)).alias("r")), "node", "left").na.fill({"r": 0.0})
    out = stage(shares(stage(weighted(edges, weight).groupBy("source", "target").agg(F.sum("w").alias("w")), "weights")).select("source", "target", "share"), "shares")
    ends = out.select(F.col("source").alias("node"), F.lit(True).alias("out"), F.lit(None).cast("boolean").alias("into")).union(out.select("target", F.lit(None).cast("boolean"), F.lit(True)))
    known = stage(start.join(ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into")), "node", "left").select("node", "r", F.col("out").isNull().alias("dangling"), F.col("into").isNotNull().alias("into")), "seeded")
    parts = [f"f{j}" for j in range(1, LEVELS + 1)]
    gone = known.where(~F.col("into") & ~F.col("dangling")).select(F.col("node").alias("source"), F.col("r").alias("f0"), *[F.lit(0.0).alias(f) for f in parts])
    left, passed = out, None
    for level in range(LEVELS):
        sums = [F.sum(F.col("share") * F.col(f)).alias(to) for f, to in zip(["f0", *parts], parts)]
        sent = stage(left.join(gone, "source").groupBy(F.col("target").alias("node")).agg(*sums), "sent")
        passed = sent if passed is None else passed.unionByName(sent)
        stay = known.where(F.col("into") & ~F.col("dangling")).select(F.col("node").alias("source")) if not level else left.select("source").distinct().join(gone, "source", "left_anti")
        left = stage(left.join(stay, "source", "left_semi") if level else left.join(stage(stay, "stay"), "source", "left_semi"), "core-edges")
        free = sent.select("node").join(left.select(F.col("target").alias("node")), "node", "left_anti").join(left.select(F.col("source").alias("node")), "node", "left_semi")
        gone = stage(passed.join(free, "node", "left_semi").groupBy("node").agg(*[F.sum(f).alias(f) for f in parts]).join(known.select("node", F.col("r").alias("f0")), "node").withColumnRenamed("node", "source"), "free")
        if gone.isEmpty():
            break
    met = left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("core", F.lit(True))
    split = stage(known.join(passed.groupBy("node").agg(*[F.sum(f).alias(f) for f in parts]), "node", "left").na.fill(0.0, parts).join(met, "node", "left").select("node", F.col("r").alias("f0"), "dangling", *parts, F.col("core").isNotNull().alias("core")), "seeded")
    parts = ["f0", *parts]
    sum_of = lambda c: sum((F.lit(x * damping**j) * F.col(f) for j, (x, f) in enumerate(zip(c, parts))), F.lit(0.0))  # noqa: E731  c: the numbers of this round and those before
    rest = split.where("not core")
    told = rest.agg(*[F.sum(F.when(F.col("dangling"), F.col(f))) for f in parts], *[F.max_by(F.struct(*parts), f) for f in parts]).collect()[0]
    lost_of, peaks = [x or 0.0 for x in told[: len(parts)]], [p for p in told[len(parts) :] if p is not None]
    weigh = lambda c, f: sum(x * damping**j * y for j, (x, y) in enumerate(zip(c, f)))
    now = stage(split.where("core").select("node", "dangling", *parts, F.col("f0").alias("rank"), F.lit(1.0).alias("moved")), "ranks")
    cyclic, c = not now.isEmpty(), [1.0] + [0.0] * len(parts)
    for i in range(rounds + 1):
        lost, moved = now.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)), F.max("moved")).collect()[0] if cyclic else (0.0, 0.0)
        lost += weigh(c, lost_of)
        step = [x - y for x, y in zip(c, c[1:])]
        settled = i > 0 and moved < tolerance and all(abs(weigh(step, p)) < tolerance for p in peaks)  # the greatest by each part first, a look at all then
        if i == rounds or settled and (rest.agg(F.max(F.abs(sum_of(step)))).collect()[0][0] or 0.0) < tolerance:
            break
        following = [(1 - damping) + damping * lost, *c[:-1]]
        if cyclic:
            flow = left.join(now, left["source"] == now["node"]).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
            rank = sum_of(following) + damping * F.coalesce("flow", F.lit(0.0))
            now = stage(now.join(flow, "node", "left").select("node", "dangling", *parts, rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")), "ranks")
        c = following
    return now.select("node", "rank").unionByName(rest.select("node", sum_of(c).alias("rank")))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): deterministic label moves to the most frequent neighbour label, ties to the least.

    Moves alternate between halves of the nodes (by hash), which keeps pairs from swapping labels for ever.
    """
    pairs = stage(undirected(edges), "pairs")
    labels = pairs.select(F.col("source").alias("node")).distinct().withColumn("community", F.col("node"))
    for r in range(rounds):
        votes = pairs.join(labels.withColumnRenamed("node", "target"), "target").groupBy("source", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("source").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("o"), "community"))["community"].alias("new"))
        move = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        labels = stage(labels.join(best, "node").select("node", F.when(move, F.col("new")).otherwise(F.col("community")).alias("community")), "labels")
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling of an undirected graph."""
    pairs = undirected(edges)
    lab = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    inside = pairs.join(lab("source"), "source").join(lab("target"), "target")
    m2 = pairs.count() or 1
    per = inside.groupBy(F.col("c_source").alias("c")).agg(F.count("*").alias("k"), F.sum((F.col("c_source") == F.col("c_target")).cast("long")).alias("own"))
    return per.agg(F.round(F.sum(F.col("own") / m2 - (F.col("k") / m2) * (F.col("k") / m2)), 6).alias("modularity"))


def incident(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(community, members, edges inside) for a labelling (node, community)."""
    lab = lambda side: paths.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    inside = edges.join(lab("source"), "source").join(lab("target"), "target").where("c_source = c_target").groupBy(F.col("c_source").alias("community")).agg(F.count("*").alias("inside"))
    return paths.groupBy("community").agg(F.count("*").alias("members")).join(inside, "community", "left").na.fill({"inside": 0})


def community_summaries(entities: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """(community, members, mean_confidence, types, summary): what a community holds, the surest names of each type first."""
    e = labels.join(entities, labels["node"] == entities["id"])
    w = Window.partitionBy("community", "entity_type").orderBy(F.desc("confidence"), "id")
    own = e.groupBy("community", "entity_type").agg(F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("c"))  # exact, whatever the order
    best = e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).groupBy("community", "entity_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ", ").alias("names"))
    line = F.concat(F.col("entity_type"), F.lit(": "), F.col("names"))
    g = own.join(best, ["community", "entity_type"]).groupBy("community").agg(F.sum("n").alias("members"), F.round(F.sum("c").cast("double") / F.sum("n").cast("double"), 6).alias("mean_confidence"), F.sort_array(F.collect_list("entity_type")).alias("types"), F.sort_array(F.collect_list(line)).alias("lines"))
    return g.select("community", "members", "mean_confidence", F.array_join("types", ",").alias("types"), F.concat(F.lit("Contains "), F.col("members").cast("string"), F.lit(" entities. "), F.array_join("lines", "; ")).alias("summary"))


def recency(at, now: int):
    """What a time's distance from now, in years of 365 days, adds: .3 up to 10, less to 50, less again to 200, then .05."""
    years = F.floor(F.abs(F.lit(now) - at) / (365 * 24 * 3600))
    return F.when(years <= 10, 0.3).when(years <= 50, 0.3 * (1 - (years - 10) / 40)).when(years <= 200, 0.1 * (1 - (years - 50) / 150)).otherwise(0.05)


def dynamic_weight(edges: DataFrame, query: list[float], concepts: list[str], now: int) -> DataFrame:
    """Adds weight: confidence x (1 + likeness to the query + recency + .15 for each concept in the type + .2 causal strength).

    edges: confidence, embedding, at, relation_type, causal_strength; a null adds nothing.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    alike = F.when(F.col("embedding").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), vx.cosine(F.col("embedding"), q)))
    when = F.when(F.col("at").isNull(), 0.0).otherwise(recency(F.col("at"), now))
    told = F.size(F.filter(F.array(*[F.lit(c.lower()) for c in concepts]), lambda c: F.contains(F.lower("relation_type"), c)))
    return edges.withColumn("weight", F.round(F.col("confidence") * (1 + alike + when + 0.15 * told + 0.2 * F.coalesce("causal_strength", F.lit(0.0))), 6))


def causal_chains(edges: DataFrame, starts: DataFrame, most_nodes: int = 5, least: float = 0.3) -> DataFrame:
    """(start, node, path, confidence, consistent, span) of simple paths with a causal step.

    edges: source, target, confidence, causal_strength, at. A step counts c (.5 + .5 s), without a strength .7 c;
    a chain is consistent if its times don't go back; a step without a time is passed over.
    """
    step = edges.where(F.col("confidence") >= least).select("source", F.col("target").alias("next"), F.when(F.col("causal_strength").isNull(), F.col("confidence") * 0.7).otherwise(F.col("confidence") * (0.5 + 0.5 * F.col("causal_strength"))).alias("c"), F.col("causal_strength").isNotNull().alias("cause"), "at")
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(1.0).alias("confidence"), F.lit(False).alias("causal"), F.lit(True).alias("consistent"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    every = None
    for _ in range(most_nodes - 1):
        g = now.join(step, now["node"] == step["source"]).where(~F.array_contains("path", F.col("next")))
        now = stage(g.select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"), (F.col("causal") | F.col("cause")).alias("causal"), (F.col("consistent") & F.coalesce(F.col("at") >= F.col("last"), F.lit(True))).alias("consistent"), F.when(F.size("path") == 1, F.col("at")).otherwise(F.col("first")).alias("first"), F.coalesce("at", "last").alias("last")), "chains")
        every = now if every is None else every.unionByName(now)
    return every.where("causal").select("start", "node", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"), "consistent", (F.col("last") - F.col("first")).alias("span"))


def expand(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(node, level): what directed edges reach from the starts (id), at the least level."""
    return hop_paths(edges, starts, depth).select("node", F.col("distance").alias("level"))
