"""Concept, import, workspace and storage queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunks, concepts
from quern.operators import entities as en
from quern.plans.queries_entities import CONCEPT_GRAPH, KEYS, NAMES, _chunks
from quern.plans.queries_paths import pagerank_sql
from quern.plans.registry import query
from quern.runtime import new_path, stage
from quern.sources import fixtures as fx
from quern.sources import importers, stores


@query()
def extract_noun_concepts(t):
    """Engines differ in what ends a word beside accents, so tests compare with module re, not SQL."""
    return concepts.noun_concepts(t.documents, "doc_id")


def _concepts(t):
    found = stage(en.generic(_chunks(t)).select("doc_id", "at", "name"), "names")
    return found, stage(en.concept_relations(found, KEYS), "relations")


BOTH = f"{CONCEPT_GRAPH}, cr as (select r.name, r.other, r.shared, round(r.shared / cast(x.n + y.n - r.shared as double), 6) as confidence from rel r join own x on x.name = r.name join own y on y.name = r.other), bo as (select name, other, confidence from cr union all select other, name, confidence from cr)"


@query(f"with {BOTH} select * from (select *, row_number() over (partition by name order by confidence desc, other) as place from bo) x where place <= 5")
def related_concepts(t):
    return concepts.related(_concepts(t)[1])


_EVEN = "1 / cast((select count(*) from nodes) as double)"
RANKED = f"with recursive {BOTH}, be as materialized (select name as source, other as target, confidence from bo), {pagerank_sql(_EVEN, 0.85, 'select name as node from own', 'be')}, dg as (select source as name, count(*) as degree from be group by 1), rk as (select o.name, coalesce(d.degree, 0) as degree, round(r.rank, 8) as rank, round(0.4 * coalesce(d.degree, 0) / cast((select count(*) - 1 from own) as double) + 0.4 * r.rank / (select max(rank) from ranks) + 0.2 * tanh(ln((select count(*) from chunk) / cast(o.n as double)) / 5), 6) as score from own o left join dg d on d.name = o.name join ranks r on r.node = o.name)"


def _ranked(t):
    found, relations = _concepts(t)
    n = chunks.fixed(t.documents).count()
    return concepts.rank(found.groupBy("name").agg(F.count("*").alias("chunks")), relations, n, 0.1)


@query(f"{RANKED} select * from rk where score >= 0.1")
def rank_concepts(t):
    return _ranked(t)


@query(f"{RANKED}, q as (select unnest(['onen', 'thea', 'ention', 'eraux']) as w) select name, round(case when bool_or(lower(name) = w) then 0.5 else 0 end + 0.3 + 0.2 * any_value(score), 6) as score from rk, q where score >= 0.1 and levenshtein(lower(name), w) <= 2 group by 1 order by 2 desc, 1 limit 20")
def match_concepts(t):
    return concepts.match("onen thea ention eraux", _ranked(t))


@query()
def refine_query(t):
    found, relations = _concepts(t)
    counts = found.groupBy("name").agg(F.count("*").alias("chunks"))
    return concepts.refine(counts.orderBy(F.desc("chunks"), "name").limit(2).select("name"), relations, counts)


@query()
def iterative_deepening(t):
    found, relations = _concepts(t)
    seeds = found.groupBy("name").agg(F.count("*").alias("n")).orderBy("n", "name").limit(1).select("name")
    return concepts.deepen(seeds, relations, found)


@query(f"with {NAMES}, asked as (select unnest(['Thea', 'Onen', 'Eraux']) as name) select doc_id, at, count(*) as hits from found where lower(name) in (select lower(name) from asked) group by 1, 2")
def lazy_query(t):
    """The lazy pipeline: names per chunk as the index, and the chunks that have an asked one."""
    f = en.generic(_chunks(t))
    return f.where(F.lower("name").isin("thea", "onen", "eraux")).groupBy("doc_id", "at").agg(F.count("*").alias("hits"))


# imports: tables of the folder are written in the format, then imported ----------------------------------------------
MAPPING = {"id": "key", "name": "title", "type": "kind", "source": "a", "target": "b", "relation": "r"}


def _written(t, format_: str, **options):
    c = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("key"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("title"), F.lit("CUSTOMER").alias("kind"), F.concat(F.lit("C"), "c_custkey").alias("a"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("b"), F.lit("LIVES_IN").alias("r"), F.col("c_mktsegment").alias("segment"))
    path = new_path(t.spark, format_)
    getattr(c.write.options(**options), "csv" if format_ in ("csv", "tsv") else "json")(path)
    return path


CSV = "select 'C' || cast(c_custkey as varchar) as id, c_name as name, 'CUSTOMER' as entity_type, c_mktsegment as segment from customer where c_custkey % 7 <> 0"


@query(CSV)
def import_csv(t):
    """Rows without a name are left out; other columns become attributes."""
    e, _ = importers.import_csv(t.spark, _written(t, "csv", header=True), MAPPING)
    return e.select("id", "name", "entity_type", F.col("attributes")["segment"].alias("segment"))


@query(CSV)
def import_tsv(t):
    e, _ = importers.import_tsv(t.spark, _written(t, "tsv", header=True, sep="\t"), MAPPING)
    return e.select("id", "name", "entity_type", F.col("attributes")["segment"].alias("segment"))


@query("select 'C' || cast(c_custkey as varchar) as source, 'N' || cast(c_nationkey as varchar) as target, 'LIVES_IN' as relation_type from customer where c_custkey % 5 <> 0")
def import_csv_relationships(t):
    return importers.import_csv(t.spark, _written(t, "csv", header=True), MAPPING)[1]


def _jsonl(t):
    e = fx.entities(t).where("entity_type in ('NATION', 'SUPPLIER')").select(F.to_json(F.struct(F.lit("Entity").alias("type"), "id", "name", "entity_type", "confidence")).alias("value"))
    r = fx.relationships(t).where("relation_type = 'PART_OF'").select(F.to_json(F.struct(F.lit("Relationship").alias("type"), "source", "target", "relation_type", "confidence")).alias("value"))
    bad = t.spark.sql("select explode(array('{\"type\": \"Entity\"}', '{broken', '{\"type\": \"Other\", \"id\": \"x\"}')) as value")
    path = new_path(t.spark, "jsonl")
    e.union(r).union(bad).write.text(path)
    return importers.import_jsonl(t.spark, path)


@query(f"with {fx.ENTITIES} select id, name, entity_type, round(confidence, 6) as confidence from entities where entity_type in ('NATION', 'SUPPLIER')")
def import_jsonl(t):
    return _jsonl(t)[0].select("id", "name", "entity_type", F.round("confidence", 6).alias("confidence"))


@query("""select unnest(['{"type": "Entity"}', '{broken', '{"type": "Other", "id": "x"}']) as value""")
def import_jsonl_rejected(t):
    return _jsonl(t)[2]


@query(f"with {fx.ENTITIES}, {fx.RELATIONSHIPS} select 'entities' as part, count(*) as n from entities where entity_type = 'NATION' union all select 'relationships', count(*) from relationships where relation_type = 'PART_OF'")
def json_load(t):
    """A graph written as JSON lines and read back whole."""
    path = new_path(t.spark, "graph-json")
    e, r = fx.entities(t).where("entity_type = 'NATION'"), fx.relationships(t).where("relation_type = 'PART_OF'")
    importers.save_json(e, r, path)
    got = importers.import_jsonl(t.spark, path)
    return got[0].agg(F.lit("entities").alias("part"), F.count("*").alias("n")).union(got[1].agg(F.lit("relationships"), F.count("*")))


@query("with e as (select 'C' || cast(c_custkey as varchar) as id, case when c_custkey % 7 = 0 then '' else c_name end as name from customer), r as (select 'C' || cast(c_custkey as varchar) as source, case when c_custkey % 5 = 0 then null else 'N' end as target from customer) select 'entity' as kind, id, 'missing id, name or type' as problem from e where name = '' union all select 'relationship', source, 'missing end or type' from r where target is null")
def import_validate(t):
    c = t.customer
    e = c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("CUSTOMER").alias("entity_type"))
    r = c.select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise("N").alias("target"), F.lit("LIVES_IN").alias("relation_type"))
    return importers.validate(e, r)


@query(f"with {fx.ENTITIES}, {fx.RELATIONSHIPS} select 'entities' as part, entity_type as kind, count(*) as n, round(sum(confidence), 4) as total from entities group by 2 union all select 'relationships', relation_type, count(*), round(sum(confidence), 4) from relationships group by 2")
def workspace_round_trip(t):
    """The graph saved as Parquet tables in a workspace and loaded again."""
    w = importers.Workspace(t.spark, new_path(t.spark, "workspaces"), "one")
    w.save(entities=fx.entities(t), relationships=fx.relationships(t))
    part = lambda name, kind: w.load(name).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total")).select(F.lit(name).alias("part"), "kind", "n", "total")
    return part("entities", "entity_type").union(part("relationships", "relation_type"))


@query("select 'html' as kind, count(*) as files, cast(sum(strlen(coalesce(html, ''))) as bigint) as bytes, count(distinct sha256(coalesce(html, ''))) as contents from pages")
def corpus_directory(t):
    """The pages written as files of a folder, then loaded: type by ending, size and content hash."""
    path = new_path(t.spark, "corpus")
    importers.write_files(t.pages.select(F.concat_ws(".", F.col("page_id").cast("string"), F.lit("html")).alias("name"), F.coalesce("html", F.lit("")).alias("text")), path)
    return importers.corpus_folder(t.spark, path).groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("content_hash").alias("contents"))


@query(f"with {fx.ENTITIES} select 'entities' as part, count(*) as n from entities union all select 'documents', count(*) from documents")
def memory_storage(t):
    store = stores.MemoryStore(entities=fx.entities(t), documents=t.documents)
    store.put("entities", fx.entities(t).where("entity_type = 'NATION'"))
    return t.spark.createDataFrame(sorted(store.stats().items()), "part string, n long")
