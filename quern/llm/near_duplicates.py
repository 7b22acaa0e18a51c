"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles, as 64-bit hashes. All sets are ordered alike, rarest
shingle first. Two sets that link share at least l shingles within their l-prefixes, for any l; a longer
prefix costs more postings but asks for more matches. Each document takes the l of least estimated cost,
from the frequencies of its own shingles, and a pair must share the smaller of its two l.

Frequencies come from one count table over all shingles of all documents, of fixed size (SKETCH counters),
so it can be broadcast; it decides the order and l, never a result. Equal sets are one class from the start.

Candidates are taken in two rounds, so that a large group of near copies doesn't become all its pairs.
First, each list of postings pairs its documents with the one of it that has the fewest rarer shingles; the
pairs are verified and joined into components. Then all other pairs of a list whose documents lie in
different components are taken, so no link that matters for components is lost. links() gives every
linked pair of classes instead.

At very large inputs, where all counters are well filled, the table tells only very frequent shingles apart;
the others then keep their hash order, which is as much a common order, so results hold and prefixes cost more.

Defined cases: a null or empty text, or one without words, has an empty set and is alone; fewer than five
words are one shingle; a null id is alone with a null component; rows with equal sets are one class;
ids are taken to be unique: rows that share an id with other texts keep their own n_shingles, but their
texts' links may meet in one component; an empty table gives an empty table; other columns are not read; a very long text is one set, held whole in one worker at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import slices, small_batches, tidy
from quern.operators.components import connected_components
from quern.runtime import attach_groups, discard, hot_keys, replicate_join, stage, sweep

#: Words of a shingle; least similarity in hundredths; log2 of the counters; most matches that a prefix asks for.
WORDS, PERCENT, SKETCH, MATCHES = 5, 80, 23, 8
#: Cost of verifying a candidate against reading a posting; postings of a list that stay together.
VERIFY, TOGETHER = 20.0, 8192
#: Bits of a set's parity map: two sets differ in as many shingles at least as their maps do in bits.
PARITY = 512
#: Least and most bits of the table of documents that must be verified: 64 for each of them, 128 MB at most.
NEEDED_BITS = (20, 30)

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of the texts of an Arrow column."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, s, np.uint64)]), dtype=np.uint64) for s in (_STEP, _BACK))

    def words(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word of some bytes, A-Z as a-z."""
        space = np.concatenate([[True], _SPACE[data], [True]])
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        self._powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.up[: len(data)], dtype=np.uint64)])
        return _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            w = self.words(data[offsets[i] : offsets[i + 1]]) if valid[i] else np.zeros(0, np.uint64)
            if not len(w):
                yield w
                continue
            k = min(WORDS, len(w))
            n = len(w) - k + 1
            total = np.full(n, k, np.uint64)
            for j in range(k):
                total += w[j : j + n] * _PLACE[j]
            yield np.unique(_mix(total))


def _over(docs: DataFrame, key: str, text: str, schema: str, start) -> DataFrame:
    """mapInArrow over (key, text) in small parts; start() gives (each part -> batches, at the end -> batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, last = start()
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                yield from each(part)
        yield from last()

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def frequencies(docs: DataFrame, key: str, text: str) -> bytes:
    """A byte for each of 2^SKETCH counters: four times the binary logarithm of its excess over the usual count.

    Each task counts into a table of its own; the tables are summed block by block in many tasks.
    """
    block = 1 << 16

    def start():
        table, shingler = np.zeros(1 << SKETCH, np.uint32), Shingler()

        def each(part):
            places = np.concatenate([np.zeros(0, np.uint64), *shingler.sets(part.column(1))]) >> np.uint64(64 - SKETCH)
            np.add.at(table, places.astype(np.int64), np.uint32(1))
            return ()

        def last():
            for b in range(0, len(table), block):
                own = table[b : b + block]
                if own.any():
                    high = np.flatnonzero(own > 255).astype(np.uint32)  # the few large counts follow the low bytes
                    packed = (own & 255).astype(np.uint8).tobytes() + high.tobytes() + (own[high] >> 8).astype(np.uint32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b // block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])

        return each, last

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(b, np.zeros(block, np.int64))
                raw = np.frombuffer(counts.as_buffer(), np.uint8)
                own += raw[:block]
                high, more = np.split(raw[block:].view(np.uint32), 2)
                own[high] += more.astype(np.int64) << 8
        for b, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "counts"])

    parts = _over(docs, key, text, "block int, counts binary", start)
    summed = parts.repartition((1 << SKETCH) // block, "block").mapInArrow(tidy(add), "block int, counts binary")
    table = np.zeros(1 << SKETCH, np.int64)
    for r in summed.toLocalIterator():
        table[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64)
    usual = float(np.median(table))
    excess = np.maximum(0, table - usual - 2 * np.sqrt(usual) - 1)
    return np.minimum(255, np.round(4 * np.log2(1 + excess))).astype(np.uint8).tobytes()


SETS = "doc_id long, n long, sig binary, matches int, tokens array<long>, splits array<int>, parity array<long>"


def prefixes(docs: DataFrame, table: bytes, key: str, text: str) -> DataFrame:
    """(doc_id, n, sig, matches, tokens, splits): each document's prefix under the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def start():
        level, shingler = np.frombuffer(shared.value, np.uint8), Shingler()
        cost = np.exp2(np.arange(256) / 4) - 1
        asked = np.arange(1, MATCHES + 1)

        def each(part):
            n, sig, matches, tokens, splits, parity = [], [], [], [], [], []
            for s in shingler.sets(part.column(1)):
                n.append(len(s))
                if not len(s):
                    sig.append(None), matches.append(0), tokens.append([]), splits.append([]), parity.append([])
                    continue
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                parity.append(np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64))
                levels = level[(s >> np.uint64(64 - SKETCH)).astype(np.int64)]
                order = np.argsort(levels, kind="stable")
                first = len(s) - (PERCENT * len(s) + 99) // 100 + 1
                sums = np.cumsum(cost[levels[order[: first + MATCHES - 1]]])
                ask = asked[: len(sums) - first + 1]
                best = int(np.argmin(sums[first + ask - 2] * (1 + VERIFY / ask))) + 1
                chosen = order[: first + best - 1]
                matches.append(best)
                tokens.append(s[chosen].view(np.int64))
                splits.append((1 + cost[levels[chosen]] // TOGETHER).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(matches, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(splits, pa.list_(pa.int32())), pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "matches", "tokens", "splits", "parity"])

        return each, lambda: ()

    return _over(docs, key, text, SETS, start)


def postings(classes: DataFrame) -> DataFrame:
    """(node, n, matches, at, token, split, splits, firsts) of shingles that two classes may share.

    firsts are three postings of the list: that with the fewest rarer shingles before it, which is the most
    typical of a group of near copies, and two by hash, which are the same in many lists of a group. A list
    with many more than TOGETHER postings is kept in splits, each with firsts of its own.
    """
    each = classes.select("node", "n", "matches", F.posexplode(F.arrays_zip("tokens", "splits")).alias("at", "x")).select("node", "n", "matches", "at", F.col("x.tokens").alias("token"), F.col("x.splits").alias("splits"))
    each = each.withColumn("split", F.when(F.col("splits") > 1, F.pmod(F.xxhash64("node"), F.col("splits"))).otherwise(F.lit(0)).cast("int"))
    first = lambda order: f"(min(struct({order} as o, struct(node, n, matches, at) as p)) over (partition by token, split)).p"
    listed = each.selectExpr("*", "count(*) over (partition by token, split) as together", f"array({first('cast(at as long)')}, {first('xxhash64(node, 1)')}, {first('xxhash64(node, 2)')}) as firsts")
    return listed.where("together > 1 or splits > 1").drop("together")


def may_link(a: str, b: str) -> str:
    """Whether a shared shingle counts for a pair: sizes near enough, and both places inside the pair's prefixes."""
    least = f"least({a}.matches, {b}.matches)"
    overlap = overlap_of(f"{a}.n", f"{b}.n")
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and {a}.at < {a}.n - {overlap} + {least} and {b}.at < {b}.n - {overlap} + {least}"


def overlap_of(a: str, b: str) -> str:
    """The least number of shared shingles of linked sets of two sizes."""
    return f"(({PERCENT} * ({a} + {b}) + {99 + PERCENT}) div {100 + PERCENT})"


def near_parity(a: str, b: str, n: str, m: str) -> str:
    """Whether two parity maps differ in few enough bits for sets of sizes n and m to link."""
    differ = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(PARITY // 64))
    return f"{differ} <= {n} + {m} - 2 * {overlap_of(n, m)}"


def counted(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that share as many prefix shingles as they must. In: structs x and y, a row for each."""
    both = pairs.selectExpr("least(x.node, y.node) as a", "greatest(x.node, y.node) as b", "least(x.matches, y.matches) as asked")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("asked").alias("asked")).where("shared >= asked").select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, hot: DataFrame) -> DataFrame:
    """The pairs that link, from their whole sets. Only documents that a pair may name leave their task.

    A document that many pairs name (hot, see hot_keys) has its set copied for parts of those pairs.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    least, most = NEEDED_BITS
    bits = min(most, max(least, (64 * ids.agg(F.approx_count_distinct("node")).collect()[0][0]).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    table = ids.select(F.floor(place("node") / 32768).alias("block"), (place("node") % 32768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    blocks = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in table.collect()})
    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), place(F.col(key).cast("long")).alias("place")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shingler = blocks.value, Shingler()
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                keep = [bool((b := known.get(p >> 15)) and b[(p & 32767) >> 3] >> (p & 7) & 1) for p in part.column(2).to_pylist()]
                some = part.filter(pa.array(keep, pa.bool_()))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.view(np.int64) for s in shingler.sets(some.column(1))], pa.list_(pa.int64()))], names=["node", "set"])

    sets = stage(wanted.mapInArrow(tidy(run), "node long, set array<long>").distinct(), "sets")
    with_b = replicate_join(pairs, sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b", "a", hot)
    joined = replicate_join(with_b, sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a", "b", hot)
    linked = joined.withColumn("i", F.size(F.array_intersect("x", "y"))).where(f"100 * i >= {PERCENT} * (size(x) + size(y) - i)")
    out = stage(linked.select("a", "b").distinct(), "links")
    discard(sets)
    return out


class Prepared:
    """The classes of equal sets and their postings, staged."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs, self.key, self.text, self.spark = docs, key, text, docs.sparkSession
        made = stage(prefixes(docs, frequencies(docs, key, text), key, text), "prefixes")
        sweep(self.spark)
        own = [F.min("doc_id").alias("node"), F.count("*").alias("copies")]
        some = made.where("sig is not null and doc_id is not null")
        self.postings = stage(postings(some.groupBy("sig").agg(*own, *[F.first(c).alias(c) for c in ("n", "matches", "tokens", "splits")])), "postings")
        self.members = stage(made.select("doc_id", "n", "sig"), "members")
        self.classes = stage(some.groupBy("sig").agg(*own, F.first("n").alias("n"), F.first("parity").alias("parity")), "classes")
        discard(made)
        sweep(self.spark)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: first by parity maps, which rule out most others, then by whole sets."""
        maps = lambda side: self.classes.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("parity").alias(f"{side}p"))
        hot = hot_keys(pairs, ["a", "b"])
        near = replicate_join(replicate_join(pairs, maps("a"), "a", "b", hot), maps("b"), "b", "a", hot)
        near = stage(near.where(near_parity("ap", "bp", "an", "bn")).select("a", "b").distinct(), "near-pairs")
        out = verified(self.docs, near, self.key, self.text, hot)
        discard(near)
        sweep(self.spark)
        return out


def star_pairs(lists: DataFrame) -> DataFrame:
    """Each posting with the firsts of its list, and the firsts of a list's splits with one of them."""
    own = lists.selectExpr("struct(node, n, matches, at) as x", "explode(array_distinct(firsts)) as y")
    firsts = lists.where("splits > 1").selectExpr("token", "split", "firsts[0] as first").distinct()
    over = firsts.selectExpr("first as x", "min(first) over (partition by token) as y").selectExpr("struct(x.node, x.n, x.matches, x.at) as x", "struct(y.node, y.n, y.matches, y.at) as y")
    return own.unionByName(over).where("x.node <> y.node").where(may_link("x", "y"))


def cross_pairs(lists: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """All postings of a list that lie in different components, but for those both in the component of its first.

    A long list is cut into parts by its minor postings (those outside the home component); each part meets
    a copy of the whole list, so no task gets more than a part's pairs.
    """
    known = lists.select("node", "n", "matches", "at", "token").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    known = stage(known, "labelled")
    lists_of = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.min(F.struct("at", "node", "c"))["c"].alias("home"))
    open_ = stage(lists_of.where("lo <> hi").select("token", "size", "home"), "open-lists")
    total = open_.agg(F.sum("size")).collect()[0][0] or 0
    limit = max(64, total // 512)
    rows = attach_groups(known, open_.withColumn("parts", F.ceil(F.col("size") / limit).cast("int")), "token", "size", ["node"], total)
    rows = stage(rows.join(classes.select("node", "parity"), "node"), "open-postings")
    minor = rows.where("c <> home").selectExpr("token as t", "cast(pmod(xxhash64(node), parts) as int) as tp", "c as xc", "struct(node, n, matches, at) as x", "parity as xp")
    every = rows.selectExpr("token", "explode(sequence(0, parts - 1)) as part", "c as yc", "home", "struct(node, n, matches, at) as y", "parity as yp")
    near = F.expr(may_link("x", "y")) & F.expr(near_parity("xp", "yp", "x.n", "y.n"))
    same = (F.col("t") == F.col("token")) & (F.col("tp") == F.col("part"))
    return minor.join(every, same & (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("home")) | (F.col("x.node") < F.col("y.node"))) & near).select("x", "y")


def resolve(p: Prepared) -> DataFrame:
    """(node, component) of every class that links with another."""
    tried = stage(counted(star_pairs(p.postings)), "star-pairs")
    labels = stage(connected_components(p.verified(tried)), "labels")
    sweep(p.spark)
    left = stage(counted(cross_pairs(p.postings, labels, p.classes)).join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    more = p.verified(left)
    names = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}c"))
    joins = more.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    merged = connected_components(joins).select(F.col("node").alias("component"), F.col("component").alias("root"))
    nodes = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): the class is the least document with an equal set."""
    p = Prepared(docs, key, text)
    found = resolve(p)
    classes = stage(p.classes.join(found, "node", "left").select("sig", "copies", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id")), "classes")
    total = classes.agg(F.sum("copies")).collect()[0][0] or 0
    rows = attach_groups(p.members.select("doc_id", "n", "sig"), classes, "sig", "copies", ["doc_id"], total, how="left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs of linked class ids, (doc_id, class_id)): every link between different sets, none left out."""
    p = Prepared(docs, key, text)
    alone = p.postings.select("node").distinct().select("node", F.col("node").alias("component"))
    pairs = p.verified(stage(counted(cross_pairs(p.postings, alone, p.classes)), "pairs"))
    classes = p.classes.select("sig", "node", "copies")
    total = classes.agg(F.sum("copies")).collect()[0][0] or 0
    return pairs, attach_groups(p.members.select("doc_id", "sig"), classes, "sig", "copies", ["doc_id"], total, how="left").select("doc_id", F.coalesce("node", "doc_id").alias("class_id"))
