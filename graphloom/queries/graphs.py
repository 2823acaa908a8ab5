"""Registered queries: graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.queries.oracle import sql
from graphloom.sources.testdata import _evidence, graph, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


TOP_NODES = "SELECT e.id, e.stable_key, e.kind, e.name, coalesce(degree, 0) AS degree FROM ent e LEFT JOIN deg d ON d.id = e.id ORDER BY coalesce(degree, 0) DESC, stable_key LIMIT 100"


@query(sql("ent deg", TOP_NODES))
def graph_export_nodes(spark, sf):
    return G.export_nodes(graph(spark, sf), 100)


@query(sql("ent deg", "SELECT id, kind, src, dst FROM rel WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY id LIMIT 200", f"top AS ({TOP_NODES.replace('LIMIT 100', 'LIMIT 3000')})"))
def graph_export_edges(spark, sf):
    g = graph(spark, sf)
    return G.export_edges(g, G.export_nodes(g, 3000), 200).select("id", "kind", "src", "dst")


@query(sql("ent deg", "SELECT 100 AS nodes, (SELECT least(200, count(*)) FROM rel WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)) AS edges, (SELECT count(*) - 100 FROM ent) AS omitted_nodes, (SELECT count(*) FROM rel) - (SELECT least(200, count(*)) FROM rel WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)) AS omitted_edges", f"top AS ({TOP_NODES})"))
def graph_export_summary(spark, sf):
    return G.export_summary(graph(spark, sf), 100, 200)


@query(sql("ent deg", """SELECT h.id, h.stable_key, h.kind, h.name, h.n_in::BIGINT AS n_in, h.n_out::BIGINT AS n_out, h.degree,
coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT r.id FROM rel r WHERE r.dst = h.id ORDER BY r.id LIMIT 5)), '') AS incoming, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT r.id FROM rel r WHERE r.src = h.id ORDER BY r.id LIMIT 5)), '') AS outgoing
FROM (SELECT e.id, e.stable_key, e.kind, e.name, n_in, n_out, degree FROM ent e JOIN deg d ON d.id = e.id ORDER BY degree DESC, n_in DESC, n_out DESC, stable_key LIMIT 20) h"""))
def graph_hubs(spark, sf):
    out = G.hubs(graph(spark, sf), 20, 5)
    return out.select("id", "stable_key", "kind", "name", "n_in", "n_out", "degree", F.array_join("incoming", ",").alias("incoming"), F.array_join("outgoing", ",").alias("outgoing"))


@query(sql("ent arcs", "SELECT e.id, e.stable_key, min(depth) AS distance FROM w JOIN ent e ON e.id = w.id GROUP BY e.id, e.stable_key", "w AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN arcs ON a = w.id WHERE depth < 2)", recursive=True))
def graph_related(spark, sf):
    return G.related(graph(spark, sf), "region://1", 2, None)


@query()
def graph_shortest_path(spark, sf):
    return G.shortest_path(graph(spark, sf), "region://1", "part://5", 6, None)


@query(sql("arcs", "SELECT min(depth) AS hops FROM w WHERE id = 'order:5'", "w AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN arcs ON a = w.id WHERE depth < 4)", recursive=True))
def graph_path_length(spark, sf):
    return G.shortest_path(graph(spark, sf), "region://1", "order://5", 6, None).agg(F.max("hop").alias("hops"))


def _pagerank_sql(k: int) -> str:
    steps = ["n AS (SELECT count(*)::DOUBLE AS n FROM ent)", "arc AS (SELECT src, dst, count(*)::DOUBLE AS m FROM rel WHERE src IN (SELECT id FROM ent) AND dst IN (SELECT id FROM ent) GROUP BY src, dst)", "outs AS (SELECT src, sum(m) AS o FROM arc GROUP BY src)", "s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM ent, n)"]
    for i in range(1, k + 1):
        p = f"s{i - 1}"
        rest = f"(SELECT (0.15 + 0.85 * (1.0 - (SELECT sum(score) FROM {p} WHERE id IN (SELECT src FROM outs)))) / n FROM n)"
        steps.append(f"s{i} AS MATERIALIZED (SELECT e.id, {rest} + 0.85 * coalesce(g.g, 0) AS score FROM {p} e LEFT JOIN (SELECT a.dst, sum(s.score * a.m / o.o) AS g FROM arc a JOIN outs o ON o.src = a.src JOIN {p} s ON s.id = a.src GROUP BY a.dst) g ON g.dst = e.id)")
    return sql("ent rel", f"SELECT e.id, e.stable_key, e.kind, round(score, 9) AS score FROM s{k} JOIN ent e USING (id)", *steps)


#: Rounds of the power iteration in SQL: far past the operator's tolerance at every scale of the test data (69 rounds).
ROUNDS = 100


@query(_pagerank_sql(ROUNDS))
def graph_pagerank(spark, sf):
    return G.pagerank(graph(spark, sf)).withColumn("score", F.round("score", 9))


def with_back_edges(spark, sf):
    """The whole graph, with a relation from each order back to its customer: the only cycles."""
    g = graph(spark, sf)
    back = read(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("dst"))
    cols = {f.name: F.lit(None).cast(f.dataType) for f in g.relations.schema.fields}
    cols |= {"id": F.concat_ws("|", F.lit("returns"), "src", "dst"), "kind": F.lit("returns"), "src": F.col("src"), "dst": F.col("dst"), "confidence": F.lit(1.0).cast("float"), "evidence": _evidence(F.lit("edges/returns"), F.lit("linker-returns"))}
    return g.with_tables(relations=g.relations.unionByName(back.select(*(c.alias(n) for n, c in cols.items()))))


@query("SELECT 2 AS length, 'calls|customer:' || o_custkey || '|order:' || o_orderkey || ',returns|order:' || o_orderkey || '|customer:' || o_custkey AS relations FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def graph_cycles(spark, sf):
    return G.cycles(with_back_edges(spark, sf), max_starts=None, limit=None).select("length", F.array_join("relations", ",").alias("relations"))


ORIENTED = "way AS (SELECT dst AS a, src AS b FROM rel WHERE kind IN ('calls', 'imports', 'implemented_by', 'documents', 'contains'))"
REACHED = "hit AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"
IMPACTED = "w AS (SELECT id, 0 AS depth FROM (VALUES ('supplier:1'), ('part:3')) v(id) UNION SELECT b, depth + 1 FROM w JOIN way ON a = w.id WHERE depth < 6)"


def _impact(spark, sf):
    g = graph(spark, sf)
    return g, G.impact(g, spark.createDataFrame([("supplier:1",), ("part:3",)], "id string"), 6)


@query(sql("ent rel", "SELECT e.id, e.stable_key, e.kind, depth FROM hit JOIN ent e USING (id)", ORIENTED, IMPACTED, REACHED, recursive=True))
def impact(spark, sf):
    return _impact(spark, sf)[1].select("id", "stable_key", "kind", "depth")


@query(sql("ent rel", "SELECT depth AS hop, count(*) AS n FROM (SELECT unnest(range(1, depth + 1)) AS depth FROM hit JOIN ent e USING (id)) GROUP BY depth", ORIENTED, IMPACTED, REACHED, recursive=True))
def impact_steps(spark, sf):
    g, hit = _impact(spark, sf)
    return G.impact_steps(g, hit).groupBy("hop").agg(F.count("*").alias("n"))


@query(sql("ent rel diag", "SELECT id FROM diag WHERE status = 'open' AND entity IN (SELECT id FROM hit JOIN ent USING (id))", ORIENTED, IMPACTED, REACHED, recursive=True))
def impact_diagnostics(spark, sf):
    g, hit = _impact(spark, sf)
    return G.impact_diagnostics(g, hit).select("id")


@query(sql("ent rel", "SELECT DISTINCT path FROM hit JOIN ent USING (id) WHERE path IS NOT NULL", ORIENTED, IMPACTED, REACHED, recursive=True))
def impact_files(spark, sf):
    g, hit = _impact(spark, sf)
    return G.impact_files(g, hit)


@query(sql("arcs", "SELECT id FROM w", "w AS (SELECT 'document:7' AS id UNION SELECT b FROM w JOIN arcs ON a = w.id)", recursive=True))
def closure(spark, sf):
    return G.closure(graph(spark, sf), spark.createDataFrame([("document:7",)], "id string"))


@query(sql("rel", "SELECT DISTINCT CASE WHEN src LIKE 'supplier:%' THEN dst ELSE src END AS id FROM rel WHERE src LIKE 'supplier:%' OR dst LIKE 'supplier:%'"))
def removed_neighbours(spark, sf):
    g = graph(spark, sf)
    return G.removed_neighbours(g, g.entities.where("id like 'supplier:%'"))


@query(sql("rel", "SELECT id FROM rel WHERE kind = 'contains' AND src LIKE 'region:%' OR kind = 'contains' AND dst LIKE 'supplier:%'"))
def induced_relations(spark, sf):
    g = graph(spark, sf)
    return G.induced(g, g.entities.where("id like 'region:%' or id like 'nation:%' or id like 'supplier:%'")).select("id")


@query(sql("", "SELECT 'region://1' AS src_key, 'nation://' || n_nationkey AS dst_key, 'contains' AS kind FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'nation://' || n_nationkey, 'customer://' || c_custkey, 'contains' FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'nation://' || n_nationkey, 'supplier://' || s_suppkey, 'contains' FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1"))
def two_hop_graph(spark, sf):
    return G.two_hop(graph(spark, sf), "region://1", "contains", "contains")


@query(sql("", "SELECT 'region://' || n_regionkey AS src_key, 'nation://' || n_nationkey AS dst_key, 'contains' AS kind FROM nation"))
def family_graph(spark, sf):
    return G.family_graph(graph(spark, sf), ("region", "nation"))


@query(sql("ent rel", "SELECT a.stable_key AS src_key, b.stable_key AS dst_key, r.kind FROM rel r JOIN ent a ON a.id = r.src JOIN ent b ON b.id = r.dst WHERE regexp_matches(a.stable_key, '^(nation|customer|supplier)://') AND regexp_matches(b.stable_key, '^(nation|customer|supplier)://') AND (split_part(a.stable_key, '/', 3) = '3' OR split_part(b.stable_key, '/', 3) = '3')"))
def segment_graph(spark, sf):
    return G.family_graph(graph(spark, sf), ("nation", "customer", "supplier"), "3")


@query(sql("ent rel", """SELECT a.stable_key AS src_key, b.stable_key AS dst_key, r.kind FROM rel r JOIN ent a ON a.id = r.src JOIN ent b ON b.id = r.dst
WHERE a.stable_key IN (SELECT stable_key FROM ent ORDER BY 1 LIMIT 5000) AND b.stable_key IN (SELECT stable_key FROM ent ORDER BY 1 LIMIT 5000) ORDER BY 1, 2, 3 LIMIT 100"""))
def bounded_graph(spark, sf):
    g = graph(spark, sf)
    return G.bounded(g.entities.where("stable_key is not null").select(F.col("stable_key").alias("key")), G.keyed_edges(g), 5000, 100)[1]


@query(sql("ent rel", """SELECT m.stable_key AS module, 4 + count(r.dst) + 3 * count(r.dst) FILTER (r.dst LIKE 'supplier:%') + CASE WHEN m.stable_key = 'nation://4' THEN 100 ELSE 0 END AS score
FROM ent m LEFT JOIN rel r ON r.src = m.id WHERE m.kind = 'module' GROUP BY m.stable_key ORDER BY score DESC, module LIMIT 8"""))
def architecture_context(spark, sf):
    g = graph(spark, sf)
    return G.architecture_context(g, g.entities.where("id like 'supplier:%' or id like 'nation:%'"), ("nation://4",), 8)


@query(sql("ent diag", "SELECT count(*) AS n, count(*) FILTER (kind = 'violates') AS violates FROM (SELECT 'violates' AS kind FROM diag WHERE status = 'open' AND kind = 'dead_endpoint' UNION ALL SELECT 'evidenced_by' FROM diag WHERE false)"))
def violation_graph(spark, sf):
    g = graph(spark, sf)
    d = g.diagnostics.withColumn("payload", F.to_json(F.struct(F.regexp_extract("id", r"(\d+)$", 1).alias("module"))))
    v = G.violations(g.with_tables(diagnostics=d), "dead_", "customer")
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "violates").alias("violates"))


@query()
def graphml_export(spark, sf):
    g = graph(spark, sf)
    nodes = G.export_nodes(g, 50)
    return G.graphml(nodes, G.export_edges(g, nodes, 100))
