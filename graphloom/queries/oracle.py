"""The canonical projection in SQL: common table expressions that queries' equivalents begin with."""

from __future__ import annotations

ENTITIES = """
ent AS (
  SELECT 'region:' || r_regionkey AS id, 'region://' || r_regionkey AS stable_key, 'package' AS kind, r_name AS name, 'ref/region/' || r_regionkey AS path, 'region-' || r_regionkey AS alias FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation://' || n_nationkey, 'module', n_name, 'ref/nation/' || n_nationkey, 'nation-' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer://' || c_custkey, 'class', c_name, 'crates/' || lower(c_mktsegment) || '/' || c_custkey, 'customer-' || c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier://' || s_suppkey, 'class', s_name, 'apps/supplier/' || s_suppkey, 'supplier-' || s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part://' || p_partkey, 'symbol', p_name, 'crates/' || lower(p_brand) || '/' || p_partkey, 'part-' || p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order://' || o_orderkey, 'function', 'order ' || o_orderkey, 'orders/' || o_orderstatus || '/' || o_orderkey, 'order-' || o_orderkey FROM orders
  UNION ALL SELECT 'document:' || doc_id, 'doc://' || source || '/' || doc_id, 'documentation_page', 'document ' || doc_id, 'docs/' || source || '/' || doc_id, 'document-' || doc_id FROM documents
)"""
RELATIONS = """
raw_rel AS (
  SELECT 'contains' AS kind, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 1.0 AS confidence FROM nation
  UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey, 1.0 FROM customer
  UNION ALL SELECT 'contains', 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 1.0 FROM supplier
  UNION ALL SELECT 'calls', 'customer:' || o_custkey, 'order:' || o_orderkey, 0.8 FROM orders
  UNION ALL SELECT DISTINCT 'imports', 'order:' || l_orderkey, 'part:' || l_partkey, 1.0 FROM lineitem
  UNION ALL SELECT DISTINCT 'implemented_by', 'part:' || l_partkey, 'supplier:' || l_suppkey, 0.7 FROM lineitem
  UNION ALL SELECT 'documents', 'document:' || doc_id, 'part:' || doc_id, 0.5 FROM documents WHERE doc_id IN (SELECT p_partkey FROM part)
),
rel AS (SELECT kind || '|' || src || '|' || dst AS id, kind, src, dst, confidence, 'edges/' || kind AS path, 'linker-' || kind AS adapter FROM raw_rel)"""
FACTS = """
fact AS (
  SELECT 'fact:' || event_id AS id, event_type AS kind, 'customer:' || user_id AS subject, props AS value, event_type AS extractor, 'events/' || event_type || '/' || (event_id % 50) AS path,
    CASE event_type WHEN 'signup' THEN 1.0 WHEN 'purchase' THEN 0.9 WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.7 WHEN 'error' THEN 0.4 ELSE 0.5 END AS confidence
  FROM events
)"""
DIAGNOSTICS = """
diag AS (
  SELECT 'diag:dead_endpoint:' || c_custkey AS id, 'dead_endpoint' AS kind, 'low' AS severity, 3 AS rank, 'open' AS status, 'dead endpoint' AS title, 'customer:' || c_custkey AS entity, 'crates/' || lower(c_mktsegment) || '/' || c_custkey AS path, 'checker-customer' AS adapter
    FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
  UNION ALL SELECT 'diag:missing_documentation:' || p_partkey, 'missing_documentation', 'medium', 2, 'open', 'missing documentation', 'part:' || p_partkey, 'crates/' || lower(p_brand) || '/' || p_partkey, 'checker-part'
    FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'diag:stale_documentation:' || l.doc_id, 'stale_documentation', 'high', 1, CASE WHEN quality = 1 THEN 'resolved' ELSE 'open' END, 'stale documentation', 'document:' || l.doc_id, 'docs/' || source || '/' || l.doc_id, 'checker-document'
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1
)"""
FILES = """
files AS (
  SELECT 'docs/' || source || '/' || doc_id AS path, md5(text) AS content_hash, lang AS language_hint FROM documents
  UNION ALL SELECT 'crates/' || lower(c_mktsegment) || '/' || c_custkey, md5(c_name), 'sql' FROM customer
)"""
OBSERVED = """
obs AS (
  SELECT path, NULL AS adapter, 1 AS entity, 0 AS fact, 0 AS relation, 0 AS diagnostic, 0 AS opened FROM ent
  UNION ALL SELECT path, extractor, 0, 1, 0, 0, 0 FROM fact
  UNION ALL SELECT path, adapter, 0, 0, 1, 0, 0 FROM rel
  UNION ALL SELECT path, adapter, 0, 0, 0, 1, CASE WHEN status = 'open' THEN 1 ELSE 0 END FROM diag
),
seen AS (SELECT * FROM obs WHERE path IS NOT NULL)"""
BOTH_WAYS = """
arcs AS (SELECT src AS a, dst AS b FROM rel UNION ALL SELECT dst, src FROM rel)"""
DEGREES = """
deg AS (SELECT id, sum(i) AS n_in, sum(o) AS n_out, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM rel UNION ALL SELECT dst, 1, 0 FROM rel) GROUP BY id)"""
ROOT = "CASE WHEN len(string_split(path, '/')) < 2 THEN path WHEN split_part(path, '/', 1) IN ('crates', 'apps', 'docs') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END"
PARTS = {"ent": ENTITIES, "rel": RELATIONS, "fact": FACTS, "diag": DIAGNOSTICS, "files": FILES, "obs": OBSERVED, "arcs": BOTH_WAYS, "deg": DEGREES}
NEEDS = {"obs": ("ent", "rel", "fact", "diag"), "arcs": ("rel",), "deg": ("rel",)}


def sql(parts: str, body: str, *more: str, recursive: bool = False) -> str:
    """A query over the named parts of the projection; ``more`` are further expressions, ``body`` the final SELECT."""
    wanted: list[str] = []
    for p in parts.split():
        for q in (*NEEDS.get(p, ()), p):
            if q not in wanted:
                wanted.append(q)
    ctes = [PARTS[p].strip() for p in wanted] + [m.strip() for m in more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body.strip() if ctes else body.strip()
