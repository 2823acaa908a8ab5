"""Registered queries: ranking, linking, checking and incremental maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.kinds import relation_weight, tenths
from graphloom.operators import check as C
from graphloom.operators import incremental as D
from graphloom.operators import link as L
from graphloom.operators import rank as R
from graphloom.queries.oracle import ROOT, sql
from graphloom.queries.reads import CHANGED, changed_paths
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


# --- ranking

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
BM25 = f"""WITH rows AS (SELECT doc_id AS id, 'title' AS field, {WORDS.format("'document ' || source")} AS ws FROM documents UNION ALL SELECT doc_id, 'body', {WORDS.format("coalesce(text, '')")} FROM documents),
lengths AS (SELECT id, field, len(ws) AS len FROM rows), stats AS (SELECT field, count(*) AS n, avg(len) AS mean FROM lengths GROUP BY field),
post AS (SELECT id, field, t AS term, count(*) AS tf FROM (SELECT id, field, unnest(ws) AS t FROM rows) WHERE t IN ('web', 'the', 'water', 'der') GROUP BY ALL), df AS (SELECT term, field, count(*) AS df FROM post GROUP BY ALL)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM post JOIN df USING (term, field) JOIN lengths USING (id, field) JOIN stats USING (field) GROUP BY id"""


@query(BM25)
def search_bm25(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("document "), "source").alias("title"), F.col("text").alias("body"))
    return R.bm25(R.postings(d), "web the water DER").select("id", F.round("score", 6).alias("score"))


@query()
def search_entities(spark, sf):
    return R.search(graph(spark, sf), "documents of nation 7", 10).drop("score")


@query(sql("ent", """SELECT id, sum(CASE WHEN lower(name) = t THEN 8 ELSE 0 END + CASE WHEN contains(x, t) THEN 1 ELSE 0 END)::BIGINT AS score, count(*) AS matched
FROM (SELECT id, name, lower(concat_ws(' ', stable_key, name, alias, path)) AS x FROM ent), (VALUES ('germany'), ('supplier'), ('11')) v(t) WHERE contains(x, t) OR lower(name) = t GROUP BY id"""))
def lexical_scores(spark, sf):
    return R.lexical_scores(graph(spark, sf), "Supplier 11, Germany")


@query("""SELECT id, max(score) AS score, string_agg(reason, ',' ORDER BY n) AS reasons FROM (SELECT DISTINCT 'part:' || l_partkey AS id, 1200 AS score, 'target' AS reason, 0 AS n FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'part:' || p_partkey, 1100, 'diff', 1 FROM part WHERE p_size < 3 UNION ALL SELECT 'part:' || p_partkey, 1000 - 10 * (rank - 1), 'search', 2 FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 40) GROUP BY id""")
def change_seeds(spark, sf):
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")).alias("id")
    a = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(part("l_partkey"), F.lit(R.TARGET_SEED).alias("score"), F.lit("target").alias("reason"))
    b = read(spark, sf, "part").where("p_size < 3").select(part("p_partkey"), F.lit(R.DIFF_SEED).alias("score"), F.lit("diff").alias("reason"))
    top = R.numbered(read(spark, sf, "part").withColumn("down", -F.col("p_retailprice")), "hit", ["down", "p_partkey"], 40).select(part("p_partkey"), F.substring("ref", 5, 4).cast("int").alias("rank"))
    return R.merged_seeds(a, b, R.search_seeds(top))


@query()
def change_map(spark, sf):
    g = graph(spark, sf)
    seeds = spark.createDataFrame([("part:3", 1200, "target"), ("supplier:1", 1100, "diff")], "id string, score long, reasons string")
    return R.change_map(g, seeds, 2, 30).withColumn("tests", F.array_join("tests", ","))


@query()
def change_files(spark, sf):
    return R.change_files(change_map(spark, sf)).select("path", "score", F.array_join("kinds", ",").alias("kinds"), F.array_join("keys", ",").alias("keys"))


@query(sql("rel", "SELECT id, CASE kind WHEN 'calls' THEN 90 WHEN 'implemented_by' THEN 90 WHEN 'imports' THEN 80 WHEN 'documents' THEN 60 ELSE 30 END + CASE kind WHEN 'calls' THEN 8 WHEN 'implemented_by' THEN 7 WHEN 'documents' THEN 5 ELSE 10 END AS weight FROM rel"))
def relation_weights(spark, sf):
    return graph(spark, sf).relations.select("id", (relation_weight() + tenths(F.col("confidence"))).cast("long").alias("weight"))


@query()
def context_pack(spark, sf):
    return R.context_pack(graph(spark, sf), "which supplier of germany", "normal")


@query("""SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS turn FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')) ORDER BY turn, p_brand LIMIT 25""")
def round_robin(spark, sf):
    return R.round_robin(read(spark, sf, "part"), "p_brand", ["p_retailprice", "p_partkey"], ["Brand#11", "Brand#22", "Brand#33"], 25).select("p_partkey", "p_brand")


@query("SELECT o_orderkey, 'risk-' || lpad((row_number() OVER (ORDER BY o_totalprice, o_orderkey))::VARCHAR, 4, '0') AS ref FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30")
def numbered_rows(spark, sf):
    return R.numbered(read(spark, sf, "orders"), "risk", ["o_totalprice", "o_orderkey"], 30).select("o_orderkey", "ref")


# --- linking


def _keyed(g, prefix, end, key, *more):
    return L.keyed(g.entities.where(F.col("id").startswith(prefix)), end, key, *more)


DIGITS = r"(\d+)$"


@query("SELECT 'customer:' || c_custkey AS src, 'supplier:' || s_suppkey AS dst, 'same_number' AS kind FROM customer JOIN supplier ON c_custkey = s_suppkey")
def link_equal_keys(spark, sf):
    g = graph(spark, sf)
    number = F.regexp_extract("id", DIGITS, 1)
    rows = L.emit(L.equi(_keyed(g, "customer:", "src", number), _keyed(g, "supplier:", "dst", number)), "same_number", 1.0, open_kind=True)
    return rows.select("src", "dst", F.col("kind_other").alias("kind"))


@query("SELECT 'document:' || doc_id AS src, 'nation:' || CASE WHEN doc_id % 40 < 25 THEN doc_id % 40 ELSE doc_id % 25 END AS dst FROM documents")
def link_first_match(spark, sf):
    g = graph(spark, sf)
    k = F.regexp_extract("id", DIGITS, 1).cast("long")
    many = F.posexplode(F.array((k % 40).cast("string"), (k % 25).cast("string"))).alias("prio", "key")
    d = g.entities.where("kind = 'documentation_page'").select(F.col("id").alias("src"), F.col("stable_key").alias("src_key"), F.col("source.path").alias("src_path"), many)
    return L.first_match(d, _keyed(g, "nation:", "dst", F.regexp_extract("id", DIGITS, 1)), ["src"]).select("src", "dst")


@query("SELECT p_brand || ' ' || p_retailprice::VARCHAR AS key, 'part:' || min(p_partkey) AS dst FROM part GROUP BY 1 HAVING count(*) = 1")
def link_unique_keys(spark, sf):
    key = F.concat_ws(" ", "p_brand", F.col("p_retailprice").cast("string"))
    return L.unique_keys(read(spark, sf, "part").select(key.alias("key"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("dst")))


@query("SELECT DISTINCT 'document:' || doc_id AS src, 'nation:' || n_nationkey AS dst FROM documents, nation WHERE contains(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), left(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]', '', 'g'), 4))")
def link_text_contains(spark, sf):
    """Documents to nations whose first four letters they contain."""
    text = read(spark, sf, "documents").select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("id"), F.to_json(F.struct("text")).alias("p"))
    g = graph(spark, sf)
    pages = g.entities.where("kind = 'documentation_page'").join(text, "id").withColumn("payload", F.col("p")).withColumn("name", F.lit("")).withColumn("aliases", F.array().cast("array<string>")).drop("p")
    ends = g.entities.where("kind = 'module'").withColumn("kind", F.lit("api_endpoint")).withColumn("payload", F.to_json(F.struct(F.substring(X.normalized(F.col("name")), 1, 4).alias("operation_id"))))
    return L.documents_endpoints(g.with_tables(entities=pages.unionByName(ends))).select("src", "dst")


@query(sql("ent rel", f"SELECT id FROM rel WHERE src IN (SELECT id FROM ent WHERE path IN ({CHANGED})) OR dst IN (SELECT id FROM ent WHERE path IN ({CHANGED}))"))
def link_affected(spark, sf):
    from graphloom.operators.query import affected_entities

    g = graph(spark, sf)
    return L.either_end(g.relations, affected_entities(g, changed_paths(spark, sf)).select("id")).select("id")


@query(sql("rel", "SELECT src, dst, 'tested_by' AS kind FROM rel WHERE kind = 'calls' AND src LIKE 'customer:%'"))
def link_tested_by(spark, sf):
    g = graph(spark, sf)
    kind = F.when(F.col("kind") == "function", "test_case").when(F.col("kind") == "class", "function").otherwise(F.col("kind"))
    calls = g.relations.where("kind = 'calls'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return L.tested_by(g.with_tables(entities=g.entities.withColumn("kind", kind)), calls).select("src", "dst", "kind")


# --- checking


@query(sql("ent rel", "SELECT id FROM ent WHERE kind = 'symbol' AND id NOT IN (SELECT dst FROM rel WHERE kind = 'documents')"))
def check_missing(spark, sf):
    g = graph(spark, sf)
    return C.missing(g.entities.where("kind = 'symbol'"), g.relations, "dst", "documents").select("id")


@query("SELECT 'part:' || p_partkey AS id FROM part SEMI JOIN lineitem ON l_partkey = p_partkey ANTI JOIN documents ON doc_id = p_partkey")
def check_implemented_undocumented(spark, sf):
    g = graph(spark, sf)
    e = g.entities.withColumn("kind", F.when(F.col("kind") == "symbol", "api_endpoint").otherwise(F.col("kind")))
    return C.not_documented(g.with_tables(entities=e)).select(F.get("entities", F.lit(0)).alias("id"))


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)")
def check_duplicates(spark, sf):
    return C.duplicates(graph(spark, sf).entities.where("kind = 'symbol'"), "name").select("id")


@query("SELECT 'customer:' || c_custkey AS id, 'nation:' || (c_custkey % 30) AS key FROM customer WHERE c_custkey % 30 >= 25")
def check_unresolved(spark, sf):
    g = graph(spark, sf)
    declared = read(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("nation:"), (F.col("c_custkey") % 30).cast("string")).alias("key"))
    return C.unresolved(declared, g.entities.select(F.col("id").alias("key"))).select("id", "key")


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)")
def check_ambiguous(spark, sf):
    declared = read(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").alias("key"))
    return C.ambiguous(declared, read(spark, sf, "events").select(F.col("user_id").alias("key"))).select("id")


@query("""SELECT user_id, coalesce(list_aggregate(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 'string_agg', ','), '') AS missing, coalesce(list_aggregate(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), 'string_agg', ','), '') AS extra
FROM (SELECT user_id, list(DISTINCT ts::DATE::VARCHAR) AS a FROM events WHERE event_type = 'purchase' GROUP BY user_id) JOIN (SELECT user_id, list(DISTINCT ts::DATE::VARCHAR) AS b FROM events WHERE event_type <> 'purchase' GROUP BY user_id) USING (user_id) WHERE list_sort(a) <> list_sort(b)""")
def check_set_drift(spark, sf):
    """Days on which a user bought, against days on which they did anything else."""
    e = read(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    a = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_set("day").alias("a"))
    b = e.where("event_type <> 'purchase'").groupBy("user_id").agg(F.collect_set("day").alias("b"))
    return C.set_drift(a, b, ["user_id"], "a", "b").select("user_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("SELECT 'document:' || doc_id AS id FROM documents WHERE doc_id % 6 = 0")
def check_page_title(spark, sf):
    g = graph(spark, sf)
    k = F.regexp_extract("id", DIGITS, 1).cast("long")
    return C.page_without_title(g.with_tables(entities=g.entities.withColumn("title", F.when(k % 6 != 0, F.col("name"))))).select(F.get("entities", F.lit(0)).alias("id"))


@query(sql("ent rel", "SELECT id FROM ent WHERE kind = 'documentation_page'"))
def check_empty_page(spark, sf):
    return C.empty_page(graph(spark, sf)).select(F.get("entities", F.lit(0)).alias("id"))


# --- incremental


def _states(spark, sf):
    d = read(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    old = d.where("doc_id % 7 <> 0").select(path.alias("path"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("text"))).alias("content_hash"), F.col("lang").alias("language_hint"))
    return D.classify(old, d.where("doc_id % 11 <> 0").select(path.alias("path"), F.md5("text").alias("content_hash"), F.col("lang").alias("language_hint")))


STATES = """SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 OR (doc_id % 5 = 0 AND text IS DISTINCT FROM 'x') THEN 'changed' ELSE 'unchanged' END AS state
FROM (SELECT *, 'docs/' || source || '/' || doc_id AS path FROM documents) WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)"""


@query(STATES)
def classify_files(spark, sf):
    return _states(spark, sf)


@query(sql("ent rel fact diag", """SELECT 'entities' AS "table", id FROM alive UNION ALL SELECT 'facts', id FROM fact WHERE subject IN (SELECT id FROM alive)
UNION ALL SELECT 'relations', id FROM rel WHERE src IN (SELECT id FROM alive) AND dst IN (SELECT id FROM alive) UNION ALL SELECT 'diagnostics', id FROM diag WHERE entity IN (SELECT id FROM alive)""", f"gone AS ({CHANGED})", "alive AS (SELECT id FROM ent WHERE path IS NULL OR path NOT IN (SELECT path FROM gone WHERE path IS NOT NULL))"))
def carried_forward(spark, sf):
    g = D.carry_forward(graph(spark, sf), changed_paths(spark, sf), "snap_0002")
    out = None
    for t in ("entities", "facts", "relations", "diagnostics"):
        rows = getattr(g, t).select(F.lit(t).alias("table"), "id")
        out = rows if out is None else out.union(rows)
    return out


@query(sql("rel", "SELECT id, CASE WHEN kind IN ('contains', 'documents') THEN 'inferred' ELSE 'verified' END AS status FROM rel"))
def upserted(spark, sf):
    r = graph(spark, sf).relations
    return D.upsert(r, r.where("kind in ('contains', 'documents')").withColumn("status", F.lit("inferred"))).select("id", "status")


@query(sql("ent", "SELECT id, CASE WHEN kind = 'class' THEN 'known ' || name END AS title, CASE WHEN kind = 'class' THEN 'sql' END AS language, CASE WHEN kind = 'class' THEN 'second' ELSE 'first' END AS payload, alias AS aliases FROM ent"))
def merged_entities(spark, sf):
    e = graph(spark, sf).entities
    first = e.withColumn("payload", F.lit("first")).withColumn("seq", F.lit(1))
    second = e.where("kind = 'class'").withColumn("title", F.concat(F.lit("known "), "name")).withColumn("language", F.lit("sql")).withColumn("payload", F.lit("second")).withColumn("aliases", F.array().cast("array<string>")).withColumn("seq", F.lit(2))
    return D.merge_entities(first.unionByName(second)).select("id", "title", "language", "payload", F.array_join("aliases", ",").alias("aliases"))


@query(sql("ent rel fact diag", "SELECT count(*) AS objects, true AS within FROM (SELECT id FROM ent UNION ALL SELECT id FROM rel UNION ALL SELECT id FROM fact UNION ALL SELECT id FROM diag)"))
def batch_guard(spark, sf):
    return D.size_guard(graph(spark, sf), 10**12, 10**15).select("objects", "within")


def _contracts(spark, sf):
    p = read(spark, sf, "part")
    kind = F.when(F.col("p_size") <= 25, "endpoint").otherwise("schema")
    key = F.concat(F.lit("part://"), F.col("p_partkey").cast("string"))
    brand = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("new "), "p_brand")).otherwise(F.col("p_brand"))
    row = lambda b: F.to_json(F.struct(b.alias("method"), F.col("p_type").alias("path"), F.array("p_name").alias("request_schemas"), F.array(F.when(F.col("p_partkey") % 6 == 0, "201").otherwise("200")).alias("responses")))
    old = p.where("p_partkey % 9 <> 0").select(kind.alias("class"), key.alias("stable_key"), F.col("p_name").alias("name"), row(F.col("p_brand")).alias("payload"))
    new = p.where("p_partkey % 10 <> 0").select(kind.alias("class"), key.alias("stable_key"), F.col("p_name").alias("name"), row(brand).alias("payload"))
    return old, new


@query("""SELECT CASE WHEN p_size <= 25 THEN 'endpoint' ELSE 'schema' END AS class, 'part://' || p_partkey AS stable_key, CASE WHEN p_partkey % 9 = 0 THEN 'added' WHEN p_partkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change
FROM part WHERE NOT (p_partkey % 9 = 0 AND p_partkey % 10 = 0) AND (p_partkey % 9 = 0 OR p_partkey % 10 = 0 OR p_partkey % 4 = 0)""")
def contract_diff(spark, sf):
    return D.contract_diff(*_contracts(spark, sf))


@query("""SELECT 'part://' || p_partkey AS stable_key, CASE WHEN p_partkey % 10 = 0 THEN 'removed' ELSE 'method_changed' END AS change FROM part WHERE p_size <= 25 AND p_partkey % 9 <> 0 AND (p_partkey % 10 = 0 OR p_partkey % 4 = 0)""")
def endpoint_changes(spark, sf):
    return D.endpoint_changes(*_contracts(spark, sf))


@query("""SELECT 'part://' || p_partkey AS stable_key, c.change, c.field FROM part, (VALUES ('required_added', 'size'), ('property_removed', 'brand'), ('property_type_changed', 'name')) c(change, field)
WHERE CASE c.change WHEN 'required_added' THEN p_partkey % 3 = 0 WHEN 'property_removed' THEN p_partkey % 5 = 0 ELSE p_partkey % 7 = 0 END""")
def schema_changes(spark, sf):
    p = read(spark, sf, "part")
    key = F.concat(F.lit("part://"), F.col("p_partkey").cast("string"))
    text = lambda req, brand, kind: F.concat(F.lit('{"schema":{"properties":{'), brand, F.lit('"name":{"type":"'), kind, F.lit('"},"size":{"type":"integer"}},"required":['), req, F.lit('],"type":"object"}}'))
    k = F.col("p_partkey")
    brand = F.lit('"brand":{"type":"string"},')
    row = lambda payload: p.select(F.lit("schema").alias("class"), key.alias("stable_key"), F.col("p_name").alias("name"), payload.alias("payload"))
    old = row(text(F.lit('"name"'), brand, F.lit("string")))
    new = row(text(F.when(k % 3 == 0, F.lit('"name","size"')).otherwise(F.lit('"name"')), F.when(k % 5 == 0, F.lit("")).otherwise(brand), F.when(k % 7 == 0, F.lit("integer")).otherwise(F.lit("string"))))
    return D.schema_changes(old, new)


@query("SELECT 'snap-' || n_nationkey AS id, n_nationkey AS seq, n_nationkey = 3 OR n_nationkey >= 19 AS kept FROM nation")
def retained_snapshots(spark, sf):
    s = read(spark, sf, "nation").select(F.concat(F.lit("snap-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq"))
    return D.retention(s, 7, "snap-3")


@query("SELECT 'diff-' || n_nationkey AS id, n_nationkey AS seq, n_nationkey >= 21 AS kept FROM nation")
def retained_diffs(spark, sf):
    s = read(spark, sf, "nation").select(F.concat(F.lit("snap-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq"))
    kept = D.retention(s, 7, "snap-3").where("kept")
    diffs = read(spark, sf, "nation").select(F.concat(F.lit("diff-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("snap-"), (F.col("n_nationkey") - 1).cast("string")).alias("old"), F.concat(F.lit("snap-"), F.col("n_nationkey").cast("string")).alias("new"))
    return D.diff_retention(diffs, kept, 4)


def _verified(spark, sf):
    g = graph(spark, sf)
    k = F.regexp_extract("id", DIGITS, 1).cast("long")
    payload = F.to_json(F.struct(F.lit("editable").alias("documentation_layer"), k.cast("string").alias("id"), F.when(k % 3 == 0, "odd").when(k % 3 == 1, "verified").alias("status"), F.concat(F.lit("snap_000"), (k % 5).cast("string")).alias("last_verified_snapshot")))
    return g.with_tables(entities=g.entities.withColumn("payload", F.when(F.col("kind") == "documentation_page", payload).otherwise(F.col("payload"))))


@query("SELECT 'document:' || doc_id AS id, 'snap_000' || (doc_id % 5) AS verified FROM documents WHERE doc_id % 5 NOT IN (3, 4)")
def docs_drift(spark, sf):
    return D.docs_drift(_verified(spark, sf), "snap_0004")


@query("""SELECT 'document:' || doc_id AS id, 'missing_field' AS issue, 'status' AS detail FROM documents WHERE doc_id % 3 = 2 AND source IS NOT NULL UNION ALL SELECT 'document:' || doc_id, 'status', 'odd' FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL
UNION ALL SELECT 'document:' || doc_id, 'stale_snapshot', 'snap_000' || (doc_id % 5) FROM documents WHERE doc_id % 5 <> 4 AND source IS NOT NULL
UNION ALL SELECT 'document:' || l.doc_id, 'diagnostic', 'diag:stale_documentation:' || l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1 AND coalesce(quality, 0) <> 1 AND source IS NOT NULL""")
def docs_check(spark, sf):
    return D.docs_check(_verified(spark, sf), "snap_0004")


@query(sql("ent diag", f"""SELECT state AS part, path AS id FROM ({STATES}) WHERE state <> 'unchanged' UNION ALL SELECT 'drift', 'document:' || doc_id FROM documents WHERE doc_id % 5 NOT IN (3, 4)
UNION ALL SELECT 'diagnostic', id FROM diag WHERE status = 'open' AND path IN (SELECT path FROM ({STATES}) WHERE state <> 'unchanged')"""))
def affected_report(spark, sf):
    return D.affected_report(_verified(spark, sf), _states(spark, sf), "snap_0004")


# --- scalar functions


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS normalized, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))), ',') AS terms FROM documents")
def text_functions(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.normalized(F.col("text")).alias("normalized"), F.array_join(X.terms(F.col("text")), ",").alias("terms"))


@query(sql("ent", f"SELECT id, {ROOT} AS root, path || ':1' AS anchor, split_part(stable_key, '://', 1) AS scheme FROM ent"))
def path_functions(spark, sf):
    p = F.col("source.path")
    return graph(spark, sf).entities.select("id", X.source_root(p).alias("root"), F.when(p.isNotNull(), X.anchor(p, F.lit(1))).alias("anchor"), X.key_parts(F.col("stable_key"))["scheme"].alias("scheme"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN 'snap_' || lpad((o_orderkey - 1)::VARCHAR, greatest(8, length(o_orderkey::VARCHAR))::INT, '0') END AS previous FROM orders")
def previous_snapshots(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return read(spark, sf, "orders").select("o_orderkey", X.previous_snapshot(F.concat(F.lit("snap_"), F.lpad(k, F.greatest(F.lit(8), F.length(k)), "0"))).alias("previous"))


def _fnv_sql() -> str:
    """FNV-1a over the bytes of short ASCII keys, in 128-bit integers."""
    return """SELECT 'nation://' || n_nationkey AS key, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length('nation://' || n_nationkey) + 1), lambda i: unicode(substring('nation://' || n_nationkey, i::INT, 1))::HUGEINT)),
lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS hash FROM nation"""


@query(_fnv_sql())
def key_hashes(spark, sf):
    key = F.concat(F.lit("nation://"), F.col("n_nationkey").cast("string"))
    return read(spark, sf, "nation").select(key.alias("key"), X.fnv1a64(key).alias("hash"))
