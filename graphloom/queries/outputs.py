"""Registered queries: sinks read back, audits, sources as rows, and functions over names and paths, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import aggregate as A
from graphloom.operators import graph as G
from graphloom.plans.staging import shared_dir
from graphloom.queries.oracle import sql
from graphloom.queries.rules import entities, facts, graph_of, page_builders, parts, surfaces
from graphloom.sinks import render
from graphloom.sinks.store import MemoryStore, read_model, write_contract, write_read_model
from graphloom.sources import files as S
from graphloom.sources.testdata import graph, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sinks


@query(sql("ent fact rel diag", "SELECT 'entities' AS \"table\", id FROM ent UNION ALL SELECT 'facts', id FROM fact UNION ALL SELECT 'relations', id FROM rel UNION ALL SELECT 'diagnostics', id FROM diag"))
def read_model_rows(spark, sf):
    folder = _fresh(spark, "model")
    write_read_model(graph(spark, sf), folder)
    g, out = read_model(spark, folder), None
    for t in ("entities", "facts", "relations", "diagnostics"):
        rows = getattr(g, t).select(F.lit(t).alias("table"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT 'endpoint' AS class, 'part://' || p_partkey AS stable_key, p_name AS name FROM part")
def contract_file(spark, sf):
    """Written once; the same again is no new file."""
    path = _fresh(spark, "contract")
    p = parts(spark, sf).select(F.lit("endpoint").alias("class"), F.concat(F.lit("part://"), "s").alias("stable_key"), F.col("p_name").alias("name"), F.lit("{}").alias("payload"))
    assert write_contract(p, path) and not write_contract(p, path)
    return spark.read.schema(p.schema).json(path).select("class", "stable_key", "name")


@query(sql("ent", "SELECT kind, count(*) AS n FROM ent GROUP BY kind"))
def memory_snapshot(spark, sf):
    store = MemoryStore(spark)
    snapshot = store.begin()
    store.put(snapshot, graph(spark, sf))
    store.commit(snapshot)
    return store.read(snapshot).entities.groupBy("kind").agg(F.count("*").alias("n"))


PAGE = "regexp_replace({0}, '[^A-Za-z0-9._-]+', '_', 'g') || '-' || left(sha256({0}), 8) || '.md'"


@query(sql("ent diag", f"SELECT 'index.md' AS path, '# Index' AS title UNION ALL SELECT 'entities/' || {PAGE.format('stable_key')}, '# ' || name FROM ent UNION ALL SELECT 'diagnostics/' || {PAGE.format('id')}, '# ' || title FROM diag"))
def wiki(spark, sf):
    return render.wiki_pages(graph(spark, sf)).select("path", F.split("text", "\n")[0].alias("title"))


@query(sql("ent deg", "SELECT e.id, degree FROM ent e JOIN deg d ON d.id = e.id ORDER BY degree DESC, stable_key LIMIT 200"))
def html_graph(spark, sf):
    """The graph view's nodes, as they are in the report's page."""
    page = render.html_report(graph(spark, sf))
    data = json.loads(page.split('id="graph">')[1].split("</script>")[0])
    return spark.createDataFrame([(n["id"], n["degree"]) for n in data["nodes"]], "id string, degree long")


@query(sql("rel", """SELECT 'modules.md' AS file, '- ' || m || ' (' || score || ')' AS line FROM (SELECT 'nation://' || n_nationkey AS m, 4 + count(dst) + 3 * count(dst) FILTER (dst LIKE 'supplier:%') AS score
FROM nation LEFT JOIN rel ON src = 'nation:' || n_nationkey OR dst = 'nation:' || n_nationkey AND false GROUP BY n_nationkey ORDER BY score DESC, m LIMIT 8)"""))
def architecture_files(spark, sf):
    g = graph(spark, sf)
    modules = G.architecture_context(g, g.entities.where("id like 'supplier:%' or id like 'nation:%'"), (), 8)
    files = render.architecture_bundle(g, modules)
    rows = [("modules.md", x) for x in files["modules.md"].split("\n") if x.startswith("- ")]
    return spark.createDataFrame(rows, "file string, line string")


# --- audits


@query("SELECT 'm' || k AS module, 'web' AS surface, CASE WHEN k % 2 = 0 THEN 'core,host' ELSE 'host' END AS layers, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS met, 3 AS total, CASE WHEN k % 2 = 0 THEN 33 ELSE 0 END AS percent FROM (SELECT p_partkey AS k FROM part)")
def surface_audit(spark, sf):
    return A.surface_audit(surfaces(spark, sf)[0]).select("module", "surface", F.array_join("layers", ",").alias("layers"), "met", "total", "percent")


@query("SELECT 'm' || k AS module, 1 + (k % 2 = 0)::INT AS met, (k % 3 = 0)::INT AS unknown, 3 AS total, ((1 + (k % 2 = 0)::INT) * 100 // 3)::INT AS percent FROM (SELECT p_partkey AS k FROM part)")
def contract_audit(spark, sf):
    p = parts(spark, sf)
    module = "concat('fba_module://m', s)"
    need = lambda name, state: facts(p, "fba_requirement", module, f"to_json(named_struct('requirement', '{name}', 'state', {state}))")
    g = graph_of(spark, [entities(p, "fba_module", module, open_kind=True)], facts=[need("a", "'met'"), need("b", "if(k % 2 = 0, 'met', 'unmet')"), need("c", "if(k % 3 = 0, 'unknown', 'unmet')")])
    return A.contract_audit(g)


@query("SELECT kind, keys, n, 0 AS with_diagnostics FROM (SELECT 'page_builder_consumer' AS kind, string_agg('page_builder_consumer://' || p_partkey, ',' ORDER BY 'page_builder_consumer://' || p_partkey) AS keys, count(*) AS n FROM part UNION ALL SELECT 'page_builder_provider', string_agg('page_builder_provider://' || p_partkey, ',' ORDER BY 'page_builder_provider://' || p_partkey), count(*) FROM part UNION ALL SELECT 'page_builder_profile', 'wide', 1)")
def page_builder_audit(spark, sf):
    return A.page_builder_audit(page_builders(spark, sf)).withColumn("keys", F.array_join("keys", ","))


# --- ranks


RANKED = 25


def _rank_sql() -> str:
    from graphloom.queries.graphs import ROUNDS, _pagerank_sql

    return _pagerank_sql(ROUNDS).replace("SELECT e.id, e.stable_key, e.kind, round(score, 9) AS score FROM", "SELECT row_number() OVER (ORDER BY round(score, 12) DESC, e.stable_key)::INT AS rank, e.stable_key FROM") + " WHERE e.kind = 'module' ORDER BY rank LIMIT 25"


@query(_rank_sql())
def graph_pagerank_top(spark, sf):
    """The nations by rank."""
    return G.pagerank(graph(spark, sf), kind="module", limit=RANKED).select("rank", "stable_key")


# --- sources as rows


PATHS = "concat(element_at(array('src/', 'target/', 'a/.git/', 'docs/', 'node_modules/x/', ''), cast(k % 6 + 1 as int)), 'f', s, element_at(array('.rs', '.MD', '.tsx', '.yml', ''), cast(k % 5 + 1 as int)))"
PATHS_SQL = "CASE k % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'target/' WHEN 2 THEN 'a/.git/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'node_modules/x/' ELSE '' END || 'f' || k || CASE k % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.MD' WHEN 2 THEN '.tsx' WHEN 3 THEN '.yml' ELSE '' END"


@query(f"SELECT {PATHS_SQL} AS path, CASE k % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'markdown' WHEN 2 THEN 'typescript' WHEN 3 THEN 'yaml' END AS language, k % 6 IN (1, 2, 4) AS ignored FROM (SELECT p_partkey AS k FROM part)")
def path_hints(spark, sf):
    p = parts(spark, sf).selectExpr(f"{PATHS} as path")
    return p.select("path", S.language_hint(F.col("path")).alias("language"), S.ignored(F.col("path")).alias("ignored"))


def _files(spark, sf, table: str, key: str, tag: str):
    return read(spark, sf, table).select(F.concat(F.lit("f/"), F.col(key).cast("string")).alias("path"), F.lit(None).cast("string").alias("language_hint"), F.concat(F.lit(tag), F.col(key).cast("string")).alias("content_hash"), F.lit(tag).alias("content"))


@query("SELECT 'f/' || k AS path, CASE WHEN k IN (SELECT s_suppkey FROM supplier) THEN 's' ELSE 'p' END || k AS content_hash FROM (SELECT s_suppkey AS k FROM supplier UNION SELECT p_partkey FROM part)")
def merged_sources(spark, sf):
    return S.merged(_files(spark, sf, "supplier", "s_suppkey", "s"), _files(spark, sf, "part", "p_partkey", "p")).select("path", "content_hash")


@query("SELECT 'f/' || p_partkey AS path FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def selected_sources(spark, sf):
    return S.selected(_files(spark, sf, "part", "p_partkey", "p"), _files(spark, sf, "supplier", "s_suppkey", "s")).select("path")


# --- functions


@query("""SELECT p_partkey AS k, trim(regexp_replace(lower(p_name || ' & ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'parts' ELSE 'stock' END AS segment, 'app::m' || p_partkey AS parent, 'Part' || p_partkey AS named,
'my-mod_' || p_partkey || ',my_mod_' || p_partkey || ',my-mod-' || p_partkey AS aliases, '&lt;' || p_name || ' &amp; &quot;x&quot;&gt;' AS escaped FROM part""")
def name_functions(spark, sf):
    p, k = parts(spark, sf), F.col("s")
    path = F.concat(F.lit("/v1/parts/{id}"), F.when(F.col("k") % 3 == 0, "/{x}").otherwise("/stock"))
    return p.select(
        "k", X.slug(F.concat("p_name", F.lit(" & "), "p_brand", F.lit("!"))).alias("slug"), X.static_segment(path).alias("segment"), X.parent_name(F.concat(F.lit("app::m"), k, F.lit("::f"))).alias("parent"), X.named_type(F.concat(F.lit("[Part"), k, F.lit("!]!"))).alias("named"),
        F.array_join(X.module_aliases(F.concat(F.lit("my-mod_"), k)), ",").alias("aliases"), X.xml_escaped(F.concat(F.lit("<"), "p_name", F.lit(' & "x">'))).alias("escaped"),
    )


CLASSES = {"src/tests/a.rs": "test", "tests/a.rs": "test", "app/a.spec.ts": "test", "x/contracts/a.json": "contract", "src/a.rs": "source", "docs/a.txt": "docs", "a.md": "docs", "a.bin": "other"}


@query("SELECT p_partkey AS k, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES.values())) + " END AS class, 'a/' || p_partkey || '/c.ts' AS resolved FROM part")
def path_classes(spark, sf):
    p = parts(spark, sf)
    path = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("k") % 8 + 1).cast("int"))
    return p.select("k", X.classified_path(path).alias("class"), X.resolved_path(F.lit("a/b"), F.concat(F.lit(".././"), "s", F.lit("/x/../c.ts"))).alias("resolved"))
