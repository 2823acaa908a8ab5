"""Registered queries: point reads and aggregations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import aggregate as A
from graphloom.operators import query as Q
from graphloom.queries.oracle import ROOT, sql
from graphloom.sources.testdata import graph, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def rounded(column: str, digits: int = 6):
    return F.round(F.col(column).cast("double"), digits).alias(column)


CHANGED = "SELECT 'docs/' || source || '/' || doc_id AS path FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'crates/' || lower(c_mktsegment) || '/' || c_custkey FROM customer WHERE c_custkey % 7 = 0"


def changed_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    c = read(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("crates/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path"))
    return d.union(c)


@query(sql("ent", "SELECT id, stable_key, name FROM ent WHERE kind = 'class' AND (contains(name, '11') OR contains(alias, '11'))"))
def entities_by_filter(spark, sf):
    return Q.query_entities(graph(spark, sf), kind="class", text="11").select("id", "stable_key", "name")


@query(sql("rel", "SELECT id, src, dst FROM rel WHERE src = 'nation:3' AND kind = 'contains'"))
def relations_by_filter(spark, sf):
    return Q.query_relations(graph(spark, sf), src="nation:3", kind="contains").select("id", "src", "dst")


@query(sql("diag", "SELECT id, kind, entity FROM diag WHERE severity = 'high' AND status = 'open'"))
def diagnostics_by_filter(spark, sf):
    return Q.query_diagnostics(graph(spark, sf), severity="HIGH", status="open").select("id", "kind", F.get("entities", F.lit(0)).alias("entity"))


@query(sql("fact", "SELECT id, value FROM fact WHERE subject = 'customer:1' AND kind = 'purchase' AND extractor = 'purchase'"))
def facts_by_filter(spark, sf):
    return Q.query_facts(graph(spark, sf), subject="customer:1", kind="Purchase", extractor="purchase").select("id", "value")


@query(sql("ent", "SELECT id, stable_key FROM ent WHERE stable_key = 'nation://7'"))
def resolved_key(spark, sf):
    g = graph(spark, sf)
    found = Q.resolve_stable_key(g, "nation://7")
    return g.entities.where(F.col("id") == found).select("id", "stable_key")


@query(sql("ent", "SELECT id, kind FROM ent WHERE path = 'apps/supplier/1'"))
def resolved_target(spark, sf):
    return Q.resolve_target(graph(spark, sf), "apps/supplier/1").select("id", "kind")


@query(sql("diag", "SELECT id, severity FROM diag WHERE status = 'open' AND kind IN ('missing_documentation', 'stale_documentation')"))
def diagnostics_of_scope(spark, sf):
    return Q.scope_filter(graph(spark, sf), "docs").select("id", "severity")


@query(sql("diag", "SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM diag WHERE status = 'open'"))
def severity_counts(spark, sf):
    return Q.severity_counts(graph(spark, sf).diagnostics.where("status = 'open'"))


@query(sql("ent", "SELECT id FROM ent WHERE path IN (SELECT path FROM changed)", f"changed AS ({CHANGED})"))
def affected_entities(spark, sf):
    return Q.affected_entities(graph(spark, sf), changed_paths(spark, sf)).select("id")


@query(sql("ent diag", "SELECT id, kind FROM diag WHERE status = 'open' AND (path IN (SELECT path FROM changed) OR entity IN (SELECT id FROM ent WHERE path IN (SELECT path FROM changed)))", f"changed AS ({CHANGED})"))
def affected_diagnostics(spark, sf):
    return Q.affected_diagnostics(graph(spark, sf), changed_paths(spark, sf)).select("id", "kind")


@query(sql("fact", "SELECT id FROM fact WHERE path IN ('events/view/3', 'events/click/4')"))
def facts_owned(spark, sf):
    paths = spark.createDataFrame([("events/view/3",), ("events/click/4",)], "path string")
    return Q.owned_by(graph(spark, sf).facts, paths).select("id")


@query(sql("diag", "SELECT id FROM diag WHERE path NOT IN (SELECT path FROM changed WHERE path IS NOT NULL) OR path IS NULL", f"changed AS ({CHANGED})"))
def diagnostics_not_owned(spark, sf):
    return Q.owned_by(graph(spark, sf).diagnostics, changed_paths(spark, sf), keep=False).select("id")


@query(sql("rel", "SELECT id FROM rel WHERE adapter IN ('linker-contains', 'linker-documents')"))
def relations_of_linkers(spark, sf):
    return Q.produced_by(graph(spark, sf).relations, ["linker-contains", "linker-documents"]).select("id")


@query("SELECT 'document:' || doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND source = (SELECT min(source) FROM documents)")
def editable_pages(spark, sf):
    g = graph(spark, sf)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    e = g.entities.where("kind = 'documentation_page'").withColumn("payload", F.to_json(F.struct(F.when(k % 3 == 0, "editable").otherwise("generated").alias("layer"))))
    first = read(spark, sf, "documents").agg(F.min("source")).first()[0]
    return Q.editable_pages(g.with_tables(entities=e), f"docs/{first}/").select("id")


@query(sql("ent rel", """SELECT r.id, r.kind, d.direction, d.neighbour, e.stable_key AS neighbour_key FROM (
SELECT id, 'out' AS direction, dst AS neighbour FROM rel WHERE src = 'part:1' UNION ALL SELECT id, 'in', src FROM rel WHERE dst = 'part:1') d JOIN rel r USING (id) LEFT JOIN ent e ON e.id = d.neighbour"""))
def explained_relations(spark, sf):
    return Q.explain(graph(spark, sf), "part://1")["relations"].select("id", "kind", "direction", "neighbour", "neighbour_key")


@query(sql("fact", "SELECT id, kind FROM fact WHERE subject = 'customer:2'"))
def explained_facts(spark, sf):
    return Q.explain(graph(spark, sf), "customer://2")["facts"].select("id", "kind")


@query(sql("ent rel", """SELECT p.id, p.stable_key, i.handler, coalesce(d.documents, '') AS documents FROM ent p
LEFT JOIN (SELECT src AS id, arg_min(e.stable_key, r.id) AS handler FROM rel r JOIN ent e ON e.id = r.dst WHERE r.kind = 'implemented_by' GROUP BY src) i ON i.id = p.id
LEFT JOIN (SELECT dst AS id, string_agg(DISTINCT e.stable_key, ',' ORDER BY e.stable_key) AS documents FROM rel r JOIN ent e ON e.id = r.src WHERE r.kind = 'documents' GROUP BY dst) d ON d.id = p.id
WHERE p.kind = 'symbol'"""))
def endpoint_registry(spark, sf):
    return Q.registry(graph(spark, sf), "symbol").select("id", "stable_key", "handler", joined("documents"))


@query(sql("ent fact", "SELECT 'entities' AS \"table\", id, 'no ownership' AS issue FROM ent WHERE kind = 'class' UNION ALL SELECT 'facts', id, 'no evidence' FROM fact WHERE kind = 'error'"))
def metadata_issues(spark, sf):
    """Classes have lost their owner, and facts of errors their evidence."""
    g = graph(spark, sf)
    lost = lambda df, column, kind: df.withColumn(column, F.when(F.col("kind") != kind, F.col(column)))
    return Q.validate_metadata(g.with_tables(entities=lost(g.entities, "ownership", "class"), facts=lost(g.facts, "evidence", "error")))


# --- aggregations


@query(sql("ent rel fact diag files", "SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM diag) AS diagnostics, (SELECT count(*) FROM diag WHERE status = 'open') AS open_diagnostics, (SELECT count(*) FROM files) AS files"))
def overview_totals(spark, sf):
    return A.overview_totals(graph(spark, sf))


@query(sql("ent", "SELECT kind AS value, count(*) AS n FROM ent GROUP BY kind"))
def entity_kinds(spark, sf):
    return A.kind_counts(graph(spark, sf))


@query(sql("rel", "SELECT kind AS value, count(*) AS n FROM rel GROUP BY kind ORDER BY n DESC, value LIMIT 3"))
def relation_kinds_top(spark, sf):
    return A.kind_counts(graph(spark, sf), "relations", 3)


@query(sql("ent", f"SELECT {ROOT} AS value, count(*) AS n FROM ent WHERE path IS NOT NULL GROUP BY 1"))
def source_roots(spark, sf):
    return A.source_roots(graph(spark, sf))


@query(sql("ent rel", """SELECT count(*) FILTER (kind = 'symbol') AS endpoints, count(*) FILTER (kind = 'class') AS schemas, count(*) FILTER (kind = 'package') AS examples,
count(*) FILTER (kind = 'symbol' AND id IN (SELECT dst FROM rel WHERE kind = 'documents')) AS documented_endpoints, count(*) FILTER (kind = 'symbol' AND id IN (SELECT src FROM rel WHERE kind = 'implemented_by')) AS implemented_endpoints FROM ent"""))
def api_overview(spark, sf):
    return A.api_overview(graph(spark, sf), "symbol", "class", "package")


@query(sql("ent", "SELECT count(*) FILTER (kind = 'documentation_page') AS pages, 0 AS sections, 0 AS runbooks, 0 AS steps, count(*) FILTER (kind = 'documentation_page' AND path LIKE 'docs/w%') AS operations_pages FROM ent"))
def docs_overview(spark, sf):
    return A.docs_overview(graph(spark, sf), "docs/w")


@query(sql("ent", 'SELECT count(*) FILTER (kind = \'class\') AS "class", count(*) FILTER (kind = \'function\') AS "function", count(*) FILTER (kind = \'module\') AS "module" FROM ent'))
def operations_overview(spark, sf):
    return A.operations_overview(graph(spark, sf), ("class", "function", "module"))


@query(sql("ent rel", """SELECT e.id AS module, e.stable_key, e.name, count(r.id) AS n_relations, coalesce(string_agg(r.id, ',' ORDER BY r.id) FILTER (r.k <= 5), '') AS relations, greatest(count(r.id) - 5, 0) AS omitted
FROM ent e LEFT JOIN (SELECT id, src, row_number() OVER (PARTITION BY src ORDER BY id) AS k FROM rel WHERE kind IN ('defines', 'contains')) r ON r.src = e.id WHERE e.kind = 'module' GROUP BY ALL"""))
def module_structure(spark, sf):
    return A.module_structure(graph(spark, sf), 5).withColumn("relations", F.array_join("relations", ","))


@query(sql("ent rel", """SELECT from_root, to_root, sum(n)::BIGINT AS n, string_agg(kind || '=' || n, ',' ORDER BY n DESC, kind) AS kinds FROM (SELECT a.root AS from_root, b.root AS to_root, r.kind, count(*) AS n FROM rel r JOIN roots a ON a.id = r.src JOIN roots b ON b.id = r.dst WHERE a.root <> b.root GROUP BY ALL) GROUP BY from_root, to_root""", f"roots AS (SELECT id, {ROOT} AS root FROM ent WHERE path IS NOT NULL)"))
def integration_boundaries(spark, sf):
    return A.boundaries(graph(spark, sf))


@query(sql("ent deg", "SELECT id, stable_key, kind, name, degree FROM ent JOIN deg USING (id) ORDER BY degree DESC, stable_key LIMIT 10"))
def overview_hubs(spark, sf):
    return A.overview_hubs(graph(spark, sf), 10).select("id", "stable_key", "kind", "name", "degree")


@query(sql("diag", "SELECT id, kind, severity, title, path || ':1' AS anchor FROM diag WHERE status = 'open' ORDER BY rank, kind, id LIMIT 50"))
def open_diagnostics(spark, sf):
    return A.open_diagnostics(graph(spark, sf), 50)


COVERED = """SELECT path, path IN (SELECT path FROM files) AS tracked, sum(entity)::BIGINT AS entities, sum(fact)::BIGINT AS facts, sum(relation)::BIGINT AS relations, sum(diagnostic)::BIGINT AS diagnostics, sum(opened)::BIGINT AS open_diagnostics,
coalesce(string_agg(DISTINCT adapter, ',' ORDER BY adapter), '') AS adapters FROM seen GROUP BY path"""


@query(sql("obs files", COVERED))
def coverage_files(spark, sf):
    return A.coverage_files(graph(spark, sf)).withColumn("adapters", F.array_join("adapters", ","))


@query(sql("obs", "SELECT adapter, count(DISTINCT path) AS files, sum(fact)::BIGINT AS facts, sum(relation)::BIGINT AS relations, sum(diagnostic)::BIGINT AS diagnostics FROM seen WHERE adapter IS NOT NULL GROUP BY adapter"))
def coverage_adapters(spark, sf):
    return A.coverage_adapters(graph(spark, sf))


@query(sql("diag", "SELECT kind, count(*) AS n, count(*) FILTER (status = 'open') AS open, count(DISTINCT path) AS files FROM diag GROUP BY kind"))
def coverage_diagnostics(spark, sf):
    return A.coverage_diagnostics(graph(spark, sf))


@query(sql("obs files", f"SELECT count(*) AS files, sum(entities)::BIGINT AS entities, sum(facts)::BIGINT AS facts, sum(relations)::BIGINT AS relations, sum(diagnostics)::BIGINT AS diagnostics, sum(open_diagnostics)::BIGINT AS open_diagnostics FROM ({COVERED})"))
def coverage_totals(spark, sf):
    return A.coverage_totals(graph(spark, sf))


PROCESSED = "SELECT DISTINCT path FROM seen WHERE fact + relation + diagnostic > 0"


@query(sql("obs", PROCESSED))
def processed_paths(spark, sf):
    return A.processed_paths(graph(spark, sf))


@query(sql("obs files", f"SELECT coalesce(language_hint, 'unknown') AS language, count(*) AS tracked, count(*) FILTER (done) AS processed, count(*) - count(*) FILTER (done) AS unprocessed, (100 * count(*) FILTER (done) // count(*))::INT AS percent FROM (SELECT *, coalesce(path IN ({PROCESSED}), false) AS done FROM files) GROUP BY 1"))
def capability_languages(spark, sf):
    return A.capability_languages(graph(spark, sf))


@query(sql("fact", "SELECT extractor AS adapter, count(DISTINCT path) AS files, count(*) AS facts, count(*) FILTER (confidence < 0.75) AS low_confidence, round(least(1.0, min(confidence))::DOUBLE, 3) AS min_confidence FROM fact GROUP BY extractor"))
def capability_adapters(spark, sf):
    return A.capability_adapters(graph(spark, sf)).withColumn("min_confidence", rounded("min_confidence", 3))


@query(sql("fact", "SELECT id, extractor AS adapter, kind, subject, round(confidence::DOUBLE, 3) AS confidence FROM fact WHERE confidence < 0.75 ORDER BY fact.confidence, adapter, id LIMIT 100"))
def low_confidence(spark, sf):
    return A.low_confidence(graph(spark, sf), 0.75, 100).withColumn("confidence", rounded("confidence", 3))


@query(sql("diag", "SELECT entity, count(*) AS n, string_agg(id, ',' ORDER BY id) AS diagnostics FROM diag WHERE status = 'open' GROUP BY entity"))
def diagnostics_per_entity(spark, sf):
    return A.diagnostics_per_entity(graph(spark, sf)).withColumn("diagnostics", F.array_join("diagnostics", ","))


@query(sql("rel", "SELECT src AS entity, string_agg(DISTINCT dst, ',' ORDER BY dst) AS tests FROM rel WHERE kind = 'calls' GROUP BY src"))
def tests_per_entity(spark, sf):
    return A.tests_per_entity(graph(spark, sf), "function").withColumn("tests", F.array_join("tests", ","))


@query("SELECT event_type AS phase, props AS adapter, count(*) AS runs, round(sum(value), 4) AS ms, sum(user_id)::BIGINT AS inputs, sum(event_id)::BIGINT AS outputs, NULL::BIGINT AS bytes FROM events GROUP BY event_type, props")
def adapter_metrics(spark, sf):
    runs = read(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("props").alias("adapter"), F.col("value").alias("ms"), F.col("user_id").alias("inputs"), F.col("event_id").alias("outputs"), F.lit(None).cast("long").alias("bytes"))
    return A.adapter_metrics(runs).withColumn("ms", F.round("ms", 4))


@query(sql("ent fact rel diag", """SELECT path, "table", part, string_agg(id, ',' ORDER BY id) AS ids
FROM (SELECT path, "table", id, ('0x' || left(md5(id), 8))::BIGINT % ((count(*) OVER (PARTITION BY path, "table") - 1) // 10000 + 1) AS part FROM owned WHERE path IS NOT NULL) GROUP BY ALL""", """owned AS (SELECT path, 'entities' AS "table", id FROM ent UNION ALL SELECT path, 'facts', id FROM fact UNION ALL SELECT path, 'relations', id FROM rel UNION ALL SELECT path, 'diagnostics', id FROM diag)"""))
def path_index(spark, sf):
    return A.path_index(graph(spark, sf)).where("path is not null").withColumn("ids", F.array_join("ids", ","))


@query(sql("ent", "SELECT stable_key, string_agg(id, ',' ORDER BY id) AS ids FROM ent GROUP BY stable_key"))
def key_index(spark, sf):
    return A.key_index(graph(spark, sf)).withColumn("ids", F.array_join("ids", ","))


@query(sql("rel diag", "SELECT 'relation' AS \"group\", kind AS value, count(*) AS n FROM rel GROUP BY kind UNION ALL SELECT 'severity', severity, count(*) FROM diag WHERE status = 'open' GROUP BY severity"))
def kind_rollup(spark, sf):
    return A.kind_pivot(graph(spark, sf))


@query("SELECT count(*) FILTER (p_size <= 10) AS endpoints, count(*) FILTER (p_size > 10 AND p_size <= 30) AS schemas, count(*) FILTER (p_size > 30) AS examples FROM part")
def api_counts(spark, sf):
    k = F.when(F.col("p_size") <= 10, "endpoint").when(F.col("p_size") <= 30, "schema").otherwise("example")
    return A.api_counts(read(spark, sf, "part").select(k.alias("class")))
