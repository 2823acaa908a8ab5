"""Registered queries: indexing of files, from extraction to a published snapshot. The files are the test tables' rows, written as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.check import check
from graphloom.operators.link import link
from graphloom.plans.index import index, staged
from graphloom.plans.staging import shared_dir, stage
from graphloom.sinks.store import Store
from graphloom.sources.extract import extract
from graphloom.sources.extractors.operations import EXTRACTORS as OPERATIONS
from graphloom.sources.files import language_hint
from graphloom.sources.testdata import dealt, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown page of each document with its whole text, which declares the module of its number, and of which every sixth has no
    heading; a TypeScript module of each part that imports the one before; a migration of each supplier."""
    d = dealt(read(spark, sf, "documents"), "doc_id")
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\nid: document-"), k, F.lit("\nentities:\n  - module://js-ts:src/part"), k, F.lit(".ts\n---\n"), F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("# Document "), k, F.lit("\n\n## Text\n\n"))).otherwise(F.lit("")))
    page = d.select(F.concat(F.lit("docs/document-"), k, F.lit(".md")).alias("path"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))
    g = dealt(read(spark, sf, "part"), "p_partkey")
    k = F.col("p_partkey").cast("string")
    before = F.concat(F.lit('import { a } from "./part'), (F.col("p_partkey") - 1).cast("string"), F.lit('";\n'))
    module = g.select(F.concat(F.lit("src/part"), k, F.lit(".ts")).alias("path"), F.concat(before, F.lit("export function load() {}\nclass Part { name() {} }\n")).alias("content"))
    k = F.col("s_suppkey").cast("string")
    migration = dealt(read(spark, sf, "supplier"), "s_suppkey").select(F.concat(F.lit("migrations/"), k, F.lit(".sql")).alias("path"), F.concat(F.lit("CREATE TABLE supplier_"), k, F.lit(" (id int);\n")).alias("content"))
    files = page.union(module).union(migration)
    return files.select("path", language_hint(F.col("path")).alias("language_hint"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), "content")


DOC = "'docs/document-' || doc_id || '.md'"
ENTITIES = f"""SELECT 'file' AS kind, {DOC} AS path, 1 AS n FROM documents UNION ALL SELECT 'documentation_page', {DOC}, 1 FROM documents UNION ALL SELECT 'documentation_section', {DOC}, 2 FROM documents WHERE doc_id % 6 <> 0
UNION ALL SELECT 'file', 'src/part' || p_partkey || '.ts', 1 FROM part UNION ALL SELECT 'module', 'src/part' || p_partkey || '.ts', 1 FROM part UNION ALL SELECT 'function', 'src/part' || p_partkey || '.ts', 2 FROM part UNION ALL SELECT 'class', 'src/part' || p_partkey || '.ts', 1 FROM part
UNION ALL SELECT 'file', 'migrations/' || s_suppkey || '.sql', 1 FROM supplier UNION ALL SELECT 'db_migration', 'migrations/' || s_suppkey || '.sql', 1 FROM supplier UNION ALL SELECT 'db_table', 'migrations/' || s_suppkey || '.sql', 1 FROM supplier"""


@query(ENTITIES)
def extracted_entities(spark, sf):
    return extract(sources(spark, sf), "snap_0001").entities.groupBy("kind", F.col("source.path").alias("path")).agg(F.count("*").alias("n"))


@query("""SELECT 'documents' AS kind, 'doc://document-' || doc_id AS src, 'module://js-ts:src/part' || doc_id || '.ts' AS dst FROM documents WHERE doc_id IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'imports', 'module://js-ts:src/part' || p_partkey || '.ts', 'module://js-ts:src/part' || (p_partkey - 1) || '.ts' FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'contains', 'file://docs/document-' || doc_id || '.md', 'doc://document-' || doc_id FROM documents
UNION ALL SELECT 'contains', 'doc://document-' || doc_id, 'doc://document-' || doc_id || '#' || s FROM documents, (VALUES ('text'), ('document-')) v(t), LATERAL (SELECT CASE t WHEN 'text' THEN t ELSE t || doc_id END AS s) WHERE doc_id % 6 <> 0""")
def linked_relations(spark, sf):
    g = staged(extract(sources(spark, sf), "snap_0001"))
    k = g.entities.select("id", "stable_key")
    r = stage(link(g), "links")
    return r.join(k.toDF("src", "a"), "src").join(k.toDF("dst", "b"), "dst").select("kind", F.col("a").alias("src"), F.col("b").alias("dst"))


@query("""SELECT kind, count(*)::INT AS n FROM (SELECT unnest(['documentation_page_missing_title', 'empty_documentation_page']) AS kind FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT 'documentation_reference_unresolved' FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS k FROM documents) WHERE k NOT IN (SELECT p_partkey FROM part)) GROUP BY kind""")
def checked_diagnostics(spark, sf):
    """Pages without a heading, and every second page's reference to a module that there is not."""
    files = sources(spark, sf)
    odd = F.regexp_extract("path", r"document-\d*[13579]\.md$", 0) != ""
    files = files.withColumn("content", F.when(odd, F.regexp_replace("content", r"js-ts:src/part(\d+)\.ts", "js-ts:src/none$1.ts")).otherwise(F.col("content")))
    g = staged(extract(files, "snap_0001"))
    g = g.with_tables(relations=stage(link(g), "links"))
    return check(g, ("checker-markdown", "checker-api")).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query(f"""SELECT kind, path, sum(n)::BIGINT AS n FROM (SELECT kind, path, n FROM ({ENTITIES}) WHERE path NOT IN (SELECT {DOC} FROM documents WHERE doc_id % 11 = 0)
UNION ALL SELECT 'documentation_section', {DOC}, 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 11 <> 0) GROUP BY kind, path""")
def indexed_snapshot(spark, sf):
    """A full index, then an incremental one in which pages change and go, read from the store."""
    import uuid

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    files = stage(sources(spark, sf), "sources")
    index(store, files)
    number = F.regexp_extract("path", r"^docs/document-(\d+)\.md$", 1)
    n = F.when(number != "", number.cast("long"))
    more = F.when(n % 5 == 0, F.concat("content", F.lit("\n## More\n"))).otherwise(F.col("content"))
    changed = files.where(F.coalesce(n % 11 != 0, F.lit(True))).withColumn("content", more).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    index(store, changed)
    return store.read().entities.groupBy("kind", F.col("source.path").alias("path")).agg(F.count("*").alias("n"))


@query("SELECT 'migrations/' || s_suppkey || '.sql' AS path, 'supplier_' || s_suppkey AS \"table\" FROM supplier")
def migration_tables(spark, sf):
    g = extract(sources(spark, sf), "snap_0001", OPERATIONS)
    return g.facts.where("kind = 'migration_creates_table'").select(F.get("ownership.source_file", F.lit(0)).alias("path"), F.get_json_object("value", "$.table").alias("table"))
