"""Document fingerprints: an exact digest of the canonical text.

The canonical text is the text in Unicode form NFKC with its case folded, every run of white space made
one space and none at the ends. Its fingerprint is the 128-bit xxh3 digest in hex. Documents with equal
digests form a bucket; a bucket's texts are compared byte by byte, and a text that differs from the
least of its bucket gets a suffix, so that equal fingerprints always mean equal canonical texts. Edited
texts, which are stored nowhere, take part in that by their SHA-256 digests.

Defined cases: a null text counts as empty; empty texts share a fingerprint; repeated rows are copies of
one another; a null id sorts last and is otherwise like any other; an empty table gives an empty table;
only the id and text columns are read, so others may have any name; a very long text is one row, and what
is held at once is it, its successor and their canonical forms.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import add_columns, slices, small_batches
from quern.runtime import stage


def canonical(text: str) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


#: Least and most bits of the table of digests that occur twice: 64 for each of them, 128 MB at most.
TWICE_BITS = (20, 30)


def twice(digests: DataFrame) -> tuple[int, list[tuple[int, bytes]]]:
    """A bit table of the digests (column fingerprint) that occur more than once: one without its bit occurs once."""
    groups = stage(digests.groupBy("fingerprint").count().where("count > 1").select(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long").alias("head")), "repeated")
    bits = min(TWICE_BITS[1], max(TWICE_BITS[0], (64 * groups.count()).bit_length()))
    place = F.shiftright("head", 32 - bits)
    table = groups.select(F.floor(place / 32768).alias("block"), (place % 32768).alias("bit")).distinct()
    return bits, [(r[0], bytes(r[1])) for r in table.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()]


def differing(docs: DataFrame, digests: DataFrame, text: str = "text") -> DataFrame:
    """(fingerprint) of the buckets whose texts aren't all equal, byte by byte.

    Only texts whose digest may occur twice leave their task, and of a bucket the least and the most only, so
    a large group of copies costs two texts a task.
    """
    bits, blocks = twice(digests)
    shared = docs.sparkSession.sparkContext.broadcast((bits, dict(blocks)))

    def start():
        bits, blocks = shared.value

        def make(texts: list) -> list:
            canon = [canonical(t or "") for t in texts]
            names = [digest(c) for c in canon]
            keep = []
            for name in names:
                at = int(name[:8], 16) >> (32 - bits)
                block = blocks.get(at >> 15)
                keep.append(block is not None and bool(block[(at & 32767) >> 3] >> (at & 7) & 1))
            return [pa.array([n if k else None for n, k in zip(names, keep)], pa.string()), pa.array([c if k else None for c, k in zip(canon, keep)], pa.binary())]

        return make

    seen = add_columns(docs.select(F.col(text).alias("text")), "text", [("fingerprint", T.StringType()), ("canon", T.BinaryType())], start, keep=[])
    ends = seen.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return ends.where("least <> most").select("fingerprint")


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (part, key, text, guest) whose partitions, sorted, hold each document beside its successor.

    The order is by descending key, null keys last. Each part is a range of keys; its first document also
    goes, as a guest, to the end of the part before, and the first of all to the end of the last part.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = base.select("key").where("key is not null").agg(F.percentile_approx("key", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).collect()[0][0] or []
    marks = sorted(set(marks), reverse=True)

    def within(lo: int, hi: int):
        """Which of the parts lo to hi, by bisection."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") >= F.lit(marks[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    part = F.when(F.col("key").isNull(), len(marks) + 1).otherwise(within(0, len(marks)))
    placed = base.withColumn("part", part)
    firsts = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.max("key").alias("key")).collect()}
    parts = sorted(firsts)
    lead = [(firsts[p], parts[i - 1]) for i, p in enumerate(parts)]  # whose first document ends which part; a row for each part
    leads = docs.sparkSession.createDataFrame(lead, T.StructType([T.StructField("first", docs.schema[key].dataType), T.StructField("host", T.IntegerType())]))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    also = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    placed = placed.join(F.broadcast(leads), F.col("key").eqNullSafe(F.col("first")), "left")
    return placed.select("key", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("at")).select("at.part", "at.guest", "key", "text")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edit, before the comparison; see op4 for the edit.

    The next document is that of the next lower key (ties: by text); after the last comes the first.
    likeness is 1.0 where canonical texts are equal byte by byte, else 0.0. A proof is the canonical text's
    SHA-256 digest, by which the texts of a bucket that turns out to hold several are told apart.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType)] + [T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("proof", T.BinaryType()), ("edited_proof", T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its successor
        for batch in batches:
            for some in slices(batch, 3):
                made = []
                for part, guest, k, t in zip(*[some.column(i).to_pylist() for i in range(4)]):
                    t = t or ""
                    canon = canonical(t)
                    now = (part, guest, k, t, canon, digest(canon))
                    if held is not None and held[0] == part and not held[1]:
                        made.append(edit(held, now, digest))
                    held = now
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=ty) for c, ty in zip(zip(*made), types)], names=schema.names)

    key_type = pa.int64() if isinstance(docs.schema[key].dataType, T.LongType) else pa.int32() if isinstance(docs.schema[key].dataType, T.IntegerType) else pa.string()
    types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    rows = neighbours(docs, key, text)
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    laid = rows.repartition(int(n), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("key"), "text")
    return small_batches(laid).mapInArrow(run, schema)


def edit(now: tuple, after: tuple, digest) -> tuple:
    text, other = now[3], after[3]
    half = len(text) // 2
    changed = text[: len(text) - half] + other[:half]
    canon = now[4] if changed == text else canonical(changed)
    return (now[2], len(text), hashlib.sha256(changed.encode()).hexdigest(), now[5], digest(canon), float(canon == now[4]), float(after[4] == now[4]), hashlib.sha256(now[4]).digest(), hashlib.sha256(canon).digest())


def told_apart(made: DataFrame, differ: DataFrame) -> DataFrame:
    """Gives all but the least text (by proof) of each bucket of several a suffix, texts and edits alike."""
    every = made.select("fingerprint", "proof").union(made.select("edited_fingerprint", "edited_proof")).distinct()
    several = every.groupBy("fingerprint").agg(F.sort_array(F.collect_set("proof")).alias("proofs")).where("size(proofs) > 1")
    several = several.unionByName(every.join(differ, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.sort_array(F.collect_set("proof")).alias("proofs"))).distinct()
    ranks = stage(several.select("fingerprint", F.posexplode("proofs").alias("rank", "proof")).where("rank > 0").select("proof", F.concat_ws("-", "fingerprint", F.col("rank").cast("string")).alias("own")), "clashes")
    if ranks.isEmpty():
        return made
    edited = ranks.select(F.col("proof").alias("edited_proof"), F.col("own").alias("edited_own"))
    out = made.join(ranks, "proof", "left").join(edited, "edited_proof", "left")
    return out.withColumns({"fingerprint": F.coalesce("own", "fingerprint"), "edited_fingerprint": F.coalesce("edited_own", "edited_fingerprint")}).drop("own", "edited_own")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edit, after the comparison inside equal buckets."""
    made = stage(with_edits(docs, key, text), "fingerprints")
    return told_apart(made, stage(differing(docs, made, text), "differing")).drop("proof", "edited_proof")
