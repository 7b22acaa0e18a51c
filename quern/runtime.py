"""What operators need of the cluster: the shared folder, staged tables and hot-key joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STAGED: dict[str, list[str]] = {}
#: Bytes of an Arrow batch on its way to Python.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in a local session, as in tests, a temporary folder is made and set; on a
    cluster, where executors couldn't see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by release() or when the driver exits."""
    path = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}-{label}"
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = []
        atexit.register(release, spark)
    _STAGED[app].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never what was staged.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def staged(spark: SparkSession) -> list[str]:
    """The paths staged so far, the latest last."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged paths; those that are gone already do no harm."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if p in _STAGED.get(sc.applicationId, []):
            _STAGED[sc.applicationId].remove(p)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done; it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Remove every staged table of this application; results that still read them must be written before."""
    try:
        sc = spark.sparkContext
        paths = _STAGED.pop(sc.applicationId, [])
        for p in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone when the interpreter exits
        return


def attach_groups(left: DataFrame, groups: DataFrame, key: str, size: str, spread: list[str], total: int, hot_share: int = 512, how: str = "inner") -> DataFrame:
    """Join rows to their group's row where a few groups may hold most of the rows.

    groups has one row for each key with its number of rows in `size`; total is the sum of those. A group
    with more than total / hot_share rows is hot. There are fewer than hot_share hot groups whatever the
    input, so they are broadcast; the other groups are joined by a shuffle in which no key has more than
    that share of the rows. Hot rows are spread over the partitions of that shuffle by a hash of `spread`.
    Null keys match no group.
    """
    limit = max(1, total // hot_share)
    cols = [c for c in groups.columns if c not in (key, size)]
    named = lambda g, p: g.select(F.col(key).alias(f"__{p}k"), *[F.struct(*[F.col(c) for c in cols]).alias(f"__{p}v")])
    hot = named(groups.where(F.col(size) > limit), "h")
    cold = named(groups.where(F.col(size) <= limit), "c").withColumn("__cs", F.lit(0).cast("long"))
    rows = left.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    spare = F.xxhash64(*[F.col(c) for c in spread])
    rows = rows.withColumn("__ls", F.when(F.col("__hv").isNotNull() | F.col(key).isNull(), F.when(spare == 0, 1).otherwise(spare)).otherwise(F.lit(0).cast("long")))
    out = rows.join(cold, (F.col(key) == F.col("__ck")) & (F.col("__ls") == F.col("__cs")), "left")
    found = F.coalesce(F.col("__hv"), F.col("__cv"))
    out = out.withColumn("__v", found)
    if how == "inner":
        out = out.where(F.col("__v").isNotNull())
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"__v.{c}").alias(c) for c in cols])


def hot_keys(rows: DataFrame, keys: list[str], hot_share: int = 512) -> DataFrame:
    """(hot, parts), staged: values that the key columns hold in more than total / hot_share rows, and into how
    many parts such rows are to be dealt. There are at most len(keys) * hot_share of them whatever the input."""
    counts = stage(rows.select(F.explode(F.array(*keys)).alias("hot")).where("hot is not null").groupBy("hot").agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    limit = max(16, total // (len(keys) * hot_share))
    return stage(counts.where(F.col("n") > limit).select("hot", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot-keys")


def replicate_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows to a table with one row for each key, where some keys hold many of the rows.

    Rows of a hot key (see hot_keys) are dealt into parts by a hash of `spread`, and the key's one row of
    `right` is copied for each part; so no task gets more than a part, and there are at most as many copies
    as parts. Unlike attach_groups, rows of `right` aren't broadcast, so they may be of any size; and the join is
    by sorting at every size, so that small inputs show what large ones cost.
    """
    named = hot.select(F.col("hot").alias("__hot"), F.col("parts").alias("__parts"))
    mark = lambda df: df.join(F.broadcast(named), F.col(key) == F.col("__hot"), "left")
    dealt = mark(left).withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int"))).drop("__hot", "__parts")
    copies = mark(right).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__hot", "__parts")
    return dealt.join(copies.hint("merge"), [key, "__part"]).drop("__part")


def ranked(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of a column that has no value twice; staged.

    Ranges of values are counted each and then numbered inside, so no task orders more than a range.
    """
    dealt = stage(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # one row for each range
    before, begins = 0, []
    for r in sizes:
        begins.append((r["__range"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(begins, "__range int, __begin long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return stage(dealt.join(F.broadcast(starts), "__range").withColumn(rank, within + F.col("__begin")).drop("__range", "__begin"), "ranked")


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session send Arrow batches of at most BATCH bytes, so that long texts don't meet in a worker."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(str(conf.get(name)).rstrip("bB")) <= BATCH:
        conf.set(name, str(BATCH))
    return df
