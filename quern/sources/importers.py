"""Readers and writers of graph data: CSV, TSV, JSON, JSON lines, N-Triples, GraphML, Parquet workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("name", T.StringType()), ("entity_type", T.StringType()), ("confidence", T.DoubleType()), ("embedding", T.ArrayType(T.FloatType())))])
RELATIONSHIP = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("target", T.StringType()), ("relation_type", T.StringType()), ("confidence", T.DoubleType()), ("context", T.ArrayType(T.StringType())))])
CHUNK = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("document_id", T.StringType()), ("content", T.StringType()), ("start_offset", T.LongType()), ("end_offset", T.LongType()), ("entities", T.ArrayType(T.StringType())))])
DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("title", T.StringType()), ("content", T.StringType()), ("metadata", T.MapType(T.StringType(), T.StringType())))])
TABLES = {"entities": ENTITY, "relationships": RELATIONSHIP, "chunks": CHUNK, "documents": DOCUMENT}


def filled(c: str):
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def import_csv(spark: SparkSession, path: str, mapping: dict[str, str], separator: str = ",") -> tuple[DataFrame, DataFrame | None]:
    """(entities, relationships or None). mapping: our column -> theirs, for id, name, type and perhaps source, target, relation.

    Rows without id, name or type are left out; other filled columns become attributes.
    """
    raw = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"')
    known = {k: raw[v] for k, v in mapping.items()}
    rest = [c for c in raw.columns if c not in mapping.values()]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in rest]) if rest else F.array().cast("array<struct<key:string,value:string>>")
    attributes = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    entities = raw.select(known["id"].alias("id"), known["name"].alias("name"), known["type"].alias("entity_type"), attributes.alias("attributes"))
    entities = entities.where(filled("id") & filled("name") & filled("entity_type"))
    if "source" not in mapping:
        return entities, None
    edges = raw.select(known["source"].alias("source"), known["target"].alias("target"), known["relation"].alias("relation_type"))
    return entities, edges.where(filled("source") & filled("target") & filled("relation_type"))


def import_tsv(spark: SparkSession, path: str, mapping: dict[str, str]):
    return import_csv(spark, path, mapping, "\t")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files {entities: [...], relationships: [...]}."""
    schema = T.StructType([T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relationships", T.ArrayType(RELATIONSHIP))])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.explode("entities").alias("e")).select("e.*"), raw.select(F.explode("relationships").alias("r")).select("r.*")


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, rejected lines) of lines tagged by `type` Entity or Relationship."""
    tagged = "type string, id string, name string, entity_type string, confidence double, source string, target string, relation_type string, _bad string"
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", tagged, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    entity = (F.col("r.type") == "Entity") & F.col("r.id").isNotNull() & F.col("r.name").isNotNull() & F.col("r.entity_type").isNotNull()
    edge = (F.col("r.type") == "Relationship") & F.col("r.source").isNotNull() & F.col("r.target").isNotNull() & F.col("r.relation_type").isNotNull()
    bad = ~F.coalesce(entity | edge, F.lit(False))
    return rows.where(entity).select("r.id", "r.name", "r.entity_type", "r.confidence"), rows.where(edge).select("r.source", "r.target", "r.relation_type", "r.confidence"), rows.where(bad).select("value")


def import_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, attributes) of N-Triples; names are what follows the last # or / of an IRI."""
    pattern = r"^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|\"((?:[^\"\\]|\\.)*)\")[^.]*\.\s*$"
    t = spark.read.text(path).select(*[F.regexp_extract("value", pattern, i).alias(c) for i, c in enumerate(("s", "p", "o", "literal"), 1)]).where("s <> ''")
    local = lambda c: F.regexp_extract(c, r"([^#/]*)$", 1)
    edges = t.where("o <> ''").select(local("s").alias("source"), local("o").alias("target"), local("p").alias("relation_type"))
    entities = t.select("s").union(t.where("o <> ''").select("o")).distinct().select(local("s").alias("id"), F.col("s").alias("iri"))
    return entities, edges, t.where("o = ''").select(local("s").alias("id"), local("p").alias("key"), F.col("literal").alias("value"))


def import_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML; data elements as a map from key to value."""
    data = "array<struct<_VALUE:string,_key:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    values = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"])))
    return nodes.select(F.col("_id").alias("id"), values.alias("attributes")), edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"), values.alias("attributes"))


def validate(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(kind, id, problem) of rejected rows."""
    e = entities.where(~(filled("id") & filled("name") & filled("entity_type"))).select(F.lit("entity").alias("kind"), "id", F.lit("missing id, name or type").alias("problem"))
    r = relationships.where(~(filled("source") & filled("target") & filled("relation_type"))).select(F.lit("relationship").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), F.lit("missing end or type").alias("problem"))
    return e.union(r)


def with_ends(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships both of whose ends exist."""
    ids = entities.select("id").distinct()
    return relationships.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*relationships.columns)


class Workspace:
    """A named folder with a Parquet table for each part of a graph."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame:
        """The table, or an empty one of its fixed schema if it was never saved."""
        fs, p = self._fs(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}") if fs.exists(p) else self.spark.createDataFrame([], TABLES[name])

    def delete(self) -> bool:
        fs, p = self._fs(self.path)
        return fs.delete(p, True)

    @staticmethod
    def names(spark: SparkSession, root: str) -> list[str]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def save_json(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """One JSON line for each row, tagged as import_jsonl reads it."""
    lines = entities.select(F.to_json(F.struct(F.lit("Entity").alias("type"), *entities.columns)).alias("value")).union(relationships.select(F.to_json(F.struct(F.lit("Relationship").alias("type"), *relationships.columns)).alias("value")))
    lines.write.mode("overwrite").text(path)


def corpus_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, bytes, content_hash, content) of a folder of text files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def write_files(df: DataFrame, folder: str, each: int = 500) -> None:
    """Writes rows (name, text) as files of a folder, about `each` by a task. A file is written beside the folder and then moved in, so
    a task that is tried again leaves no half file. Names are unique and without slashes; the folder is there even without rows."""
    aside = f"{folder.rstrip('/')}-unfinished"

    def run(batches):
        import uuid

        import pyarrow.fs as pafs

        def opened(path: str):  # Spark's names for a store count as Arrow's
            scheme, found, rest = path.partition("://")
            if found:
                return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)
            return pafs.LocalFileSystem(), path.removeprefix("file:")

        (fs, root), (_, other) = opened(folder), opened(aside)
        for path in (root, other):
            fs.create_dir(path, recursive=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                made = f"{other}/{uuid.uuid4().hex}"
                with fs.open_output_stream(made, compression=None) as out:
                    out.write((text or "").encode())
                fs.move(made, f"{root}/{name}")
            yield batch[["name"]]

    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    path(folder).getFileSystem(conf).mkdirs(path(folder))
    dealt = df.select("name", "text").repartition(max(1, -(-df.count() // each)), "name")
    dealt.mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
    path(aside).getFileSystem(conf).delete(path(aside), True)
