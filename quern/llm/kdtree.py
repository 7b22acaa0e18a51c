"""Sharding by a k-d tree whose cuts are weighted medians.

Every node holds a box of the metadata space and a number of shards. It is cut along its widest dimension
at the point where the sizes below stand to those above as the shards of its two children; so all leaves,
one for each shard, hold near equal bytes whatever the distribution. The number of leaves is given, or it
follows from the bytes that a leaf is to reach. Only DataFrame functions run: the tree is found level by
level from histograms (at most SUMS sums at once come to the driver, whatever the input), then applied as
one expression.

Each coordinate is a long: the value in its upper bits, a hash of the row in its lower bits. So a value that
a third of all rows share is still cut at the right place. The hash takes in the row's number, so that rows
that agree in everything are dealt out like others.

Defined cases: a null text has no bytes (size 16) and checksum 0; null metadata is a value of its own;
repeated rows are rows of their own; an empty table gives an empty table; only the named columns are read;
a very long text is one row of its size and makes the shard that holds it as much larger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import stage

#: Sums that a histogram of all nodes may have, bins of one node's, and the share of a shard by which a cut may be off.
SUMS, BINS, SLACK = 1 << 18, 1024, 0.001
#: Bits of a coordinate's value and of the hash below it.
HIGH, LOW = 28, 32
#: Most leaves of a tree, which is kept on the driver and in an expression.
MOST = 1 << 13


def coordinates(df: DataFrame, key: str) -> list[Column]:
    """Size (logarithmic), source, language and text checksum, each as a long of HIGH + LOW bits."""
    tie = F.xxhash64(F.col(key), F.col("text_crc32"), F.col("row"), F.lit(7)).bitwiseAND((1 << LOW) - 1)
    high = lambda c: (F.coalesce(c, F.lit(0)).cast("long").bitwiseAND((1 << HIGH) - 1)) * F.lit(1 << LOW) + tie
    named = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit("\0null"))).bitwiseAND((1 << HIGH) - 1) if c in df.columns else F.lit(0)
    return [high(F.log2(F.col("size")) * F.lit((1 << HIGH) / 64)), high(named("source")), high(named("lang")), high(F.shiftright(F.col("text_crc32"), 32 - HIGH))]


def table(values: dict[int, int], size: int, kind: str, none: int = -1) -> str:
    """Values by number as an array literal."""
    return "array(" + ",".join(f"{values.get(i, none)}{'L' if kind == 'long' else ''}" for i in range(size)) + ")"


class Tree:
    """Nodes as a heap (children of i: 2i + 1 and 2i + 2): dimension and cut of each inner node, shards of each.

    Its columns look values up in array literals, so every level and round runs the same compiled code.
    """

    def __init__(self, shards: int):
        self.shards: dict[int, range] = {0: range(shards)}
        self.dim: dict[int, int] = {}
        self.cut: dict[int, int] = {}
        self.depth = max(1, math.ceil(math.log2(max(2, shards))))
        self.size = 2 ** (self.depth + 1)

    def node(self) -> Column:
        """The leaf, or the node not cut yet, in which a row of column coords lies."""
        dim, cut = f"get({table(self.dim, self.size, 'int')}, n)", f"get({table(self.cut, self.size, 'long')}, n)"
        return F.expr(f"aggregate(sequence(1, {self.depth}), 0, (n, _) -> case when {dim} < 0 then n else 2 * n + 1 + cast(get(coords, {dim}) >= {cut} as int) end)")

    def shard(self) -> Column:
        return F.get(F.expr(table({i: r.start for i, r in self.shards.items()}, self.size, "int")), self.node())

    def split(self, node: int) -> None:
        r = self.shards[node]
        mid = r.start + len(r) // 2
        self.shards[2 * node + 1], self.shards[2 * node + 2] = range(r.start, mid), range(mid, r.stop)


def histogram(placed: DataFrame, spans: dict[tuple[int, int], tuple[int, int]], size: int, dims: int) -> dict[tuple[int, int], list[tuple]]:
    """For each (node, dimension) of spans, its range [lo, hi] in equal bins: (bytes, least, most) of each bin that has rows."""
    bins = max(16, min(BINS, SUMS // len(spans)))
    place = lambda f: table({n * dims + d: f(*s) for (n, d), s in spans.items()}, size * dims, "long", -1)
    look = lambda f: F.get(F.expr(place(f)), F.expr(f"node * {dims} + dim"))
    each = placed.select("node", "size", F.posexplode("coords").alias("dim", "x"))
    each = each.select("node", "dim", "size", "x", look(lambda lo, hi: lo).alias("lo"), look(lambda lo, hi: hi).alias("hi"), look(lambda lo, hi: max(1, -(-(hi - lo + 1) // bins))).alias("width"))
    found: dict[tuple[int, int], list[tuple]] = {}
    sums = each.where("lo >= 0 and x between lo and hi").groupBy("node", "dim", F.expr("(x - lo) div width").alias("bin")).agg(F.sum("size").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
    for r in sorted(sums.collect()):
        found.setdefault((r["node"], r["dim"]), []).append((r["w"], r["least"], r["most"]))
    return found


def median(bins: list[tuple], need: int) -> tuple[int, int, int, int]:
    """(bytes before, bytes, least, most) of the bin in which the sum of bytes reaches `need`."""
    gone = 0
    for w, least, most in bins:
        if gone + w >= need:
            break
        gone += w
    else:
        gone -= w
    return gone, w, least, most


def grow(points: DataFrame, n_dims: int, shards: int) -> Tree:
    """The tree over points (coords, size); reads them about twice for each of its log2(shards) levels."""
    tree = Tree(shards)
    ends = points.agg(F.sum("size").alias("w"), *[f(F.col("coords")[d]).alias(f"{n}{d}") for d in range(n_dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()[0]
    if ends["w"] is None:  # no rows
        return tree
    slack = SLACK * ends["w"] / shards
    box = {(0, d): (ends[f"lo{d}"], ends[f"hi{d}"]) for d in range(n_dims)}
    extent = [max(1, hi - lo) for lo, hi in box.values()]
    while open_ := [i for i, r in tree.shards.items() if len(r) > 1 and i not in tree.dim]:
        placed = points.select("coords", "size", tree.node().alias("node"))
        spans = {(i, d): box[i, d] for i in open_ for d in range(n_dims) if (i, d) in box}
        seek: dict[int, tuple[int, int]] = {}
        while spans:  # the first round looks at all dimensions, each further one narrows a node's cut to a bin
            found, spans = histogram(placed, spans, tree.size, n_dims), {}
            for i in [i for i in open_ if i not in tree.dim and (i, 0) in found or i in seek]:
                if i not in seek:
                    for d in range(n_dims):
                        box[i, d] = found[i, d][0][1], found[i, d][-1][2]
                    dim = max(range(n_dims), key=lambda d: ((box[i, d][1] - box[i, d][0]) / extent[d], -d))
                    total = sum(w for w, _, _ in found[i, dim])
                    seek[i] = dim, total * (len(tree.shards[i]) // 2) // len(tree.shards[i])
                dim, need = seek[i]
                gone, w, least, most = median(found[i, dim], need)
                if w <= slack or least == most:
                    tree.dim[i], tree.cut[i] = dim, least if need - gone < w / 2 else most + 1
                    del seek[i]
                else:
                    seek[i], spans[i, dim] = (dim, need - gone), (least, most)
        for i in open_:
            if i not in tree.dim:  # no row lies here
                tree.dim[i], tree.cut[i] = 0, 0
            tree.split(i)
            for child in (2 * i + 1, 2 * i + 2):
                for d in range(n_dims):
                    if (i, d) in box:
                        lo, hi = box[i, d]
                        if d == tree.dim[i]:
                            lo, hi = (lo, min(hi, tree.cut[i] - 1)) if child == 2 * i + 1 else (max(lo, tree.cut[i]), hi)
                        box[child, d] = lo, hi
                if any(box.get((child, d), (0, 0))[0] > box.get((child, d), (0, 0))[1] for d in range(n_dims)):
                    box = {k: v for k, v in box.items() if k[0] != child}  # nothing lies there
    return tree


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Each row's size, checksum, shard and slot; slots are gapless from 0 in a shard, in no promised order.

    Give the number of shards, or target_bytes, which a leaf reaches: as many shards as the sizes need of it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    meta = [c for c in ("lang", "source") if c in docs.columns]
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), *meta)
    dims = coordinates(sized, "doc_id")
    points = stage(sized.select("row", "doc_id", "size", "text_crc32", F.array(*dims).alias("coords")), "points")
    rows, total = points.agg(F.count("*"), F.sum("size")).collect()[0]
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    if shards > MOST:
        raise ValueError(f"a tree of {shards} leaves; at most {MOST}: give a larger target, or cut shards again")
    placed = points.select("row", "doc_id", "size", "text_crc32", grow(points, len(dims), shards).shard().cast("int").alias("shard"))
    return with_slots(placed, rows, shards)


def with_slots(placed: DataFrame, rows: int, shards: int, most: int = 20_000) -> DataFrame:
    """Numbers the rows of each shard from 0: first within small buckets, then by the buckets' sums.

    A bucket has about `most` rows and a shard's list of buckets one row for each, so no task holds a shard.
    """
    buckets = max(8, math.ceil(rows / shards / most))
    spread = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = spread.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    own = spread.selectExpr("*", "row_number() over (partition by shard, bucket order by row) - 1 as own")
    return own.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
