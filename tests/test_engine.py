"""Operators on small graphs, extractors on small files, and the store's life cycle."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import KnowledgeGraph, conform
from graphloom.operators import check as C
from graphloom.operators import graph as G
from graphloom.operators import link as L
from graphloom.operators import rank as R
from graphloom.operators.incremental import classify, merge_entities, planned_scope, retention
from graphloom.plans.index import index
from graphloom.plans.registry import Registry
from graphloom.sinks.store import MemoryStore, NotCommitted, Store
from graphloom.sources.extract import Out, Source, extract, fnv
from graphloom.sources.extractors import graphql, javascript, markdown, openapi, operations, rust
from graphloom.sources.files import porcelain, scan


def small(spark, edges, kinds=None):
    """A graph of (src, kind, dst), with keys like ids."""
    ids = sorted({x for a, _, b in edges for x in (a, b)} | set(kinds or {}))
    own = lambda p: [{"source_file": p}]
    ev = lambda p: [{"source_file": p, "line_start": 1, "line_end": 1, "extractor": "t", "commit_hash": None, "confidence": 1.0, "status": "verified"}]
    e = spark.createDataFrame([(i, f"k://{i}", (kinds or {}).get(i, "function"), i, own(f"src/{i}"), f"src/{i}") for i in ids], "id string, stable_key string, kind string, name string, ownership array<struct<source_file:string>>, path string")
    e = e.withColumn("source", F.struct("path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))).withColumn("aliases", F.array().cast("array<string>")).withColumn("payload", F.lit("{}"))
    r = spark.createDataFrame([(f"{a}-{k}-{b}", k, a, b, 1.0, own("src"), ev("src")) for a, k, b in edges] or [], "id string, kind string, src string, dst string, confidence float, ownership array<struct<source_file:string>>, evidence array<struct<source_file:string,line_start:int,line_end:int,extractor:string,commit_hash:string,confidence:float,status:string>>")
    g = KnowledgeGraph.empty(spark)
    return g.with_tables(entities=conform(e, "entities"), relations=conform(r, "relations"))


def out(extractor, path, text, hint):
    o = Out("t", path)
    extractor(Source(path, hint, "h", text), o)
    return o.rows


def by_kind(rows, kind):
    return {r["stable_key"]: json.loads(r["payload"]) for r in rows if r["table"] == "entities" and kind in (r["kind"], r["kind_other"])}


def test_walk_order_and_cap(spark):
    g = small(spark, [("a", "calls", "c"), ("b", "calls", "a"), ("c", "calls", "d"), ("b", "calls", "e")])
    visits, cut = G.walk(g, ["a"], 2, 10)
    assert [(v.id, v.depth) for v in visits] == [("a", 0), ("b", 1), ("c", 1), ("e", 2), ("d", 2)] and not cut
    visits, cut = G.walk(g, ["a"], 2, 3)
    assert [v.id for v in visits] == ["a", "b", "c"] and cut


def test_path(spark):
    g = small(spark, [("a", "calls", "b"), ("c", "calls", "b"), ("c", "calls", "d"), ("z", "calls", "z")])
    assert [(r["src"], r["dst"], r["forward"]) for r in G.shortest_path(g, "k://a", "k://d").collect()] == [("a", "b", True), ("b", "c", False), ("c", "d", True)]
    assert not G.shortest_path(g, "k://a", "k://z").collect()
    with pytest.raises(LookupError):
        G.shortest_path(g, "k://a", "k://unknown")


def test_staged_walks_are_as_the_drivers(spark):
    """Without a cap: the same path, ties among ways included, and the same entities around one."""
    g = small(spark, [("a", "calls", "c"), ("a", "calls", "b"), ("b", "calls", "d"), ("c", "contains", "d"), ("d", "calls", "e"), ("e", "calls", "e"), ("y", "calls", "z")])
    for key in ("k://d", "k://e", "k://a", "k://z"):
        assert G.shortest_path(g, "k://a", key, max_visited=None).collect() == G.shortest_path(g, "k://a", key).collect()
    for depth in (1, 2, 4):
        assert sorted(G.related(g, "k://b", depth, None).collect()) == sorted(G.related(g, "k://b", depth).collect())
    assert {r["id"] for r in G.closure(g, spark.createDataFrame([("e",)], "id string")).collect()} == set("abcde")


def test_graphml_and_change_files(spark):
    g = small(spark, [("a", "calls", "b<c")])
    nodes = G.export_nodes(g, 10)
    text = "\n".join(r["line"] for r in sorted(G.graphml(nodes, G.export_edges(g, nodes, 10)).collect()))
    import xml.etree.ElementTree as ET

    found = [x for x in ET.fromstring(text).iter()]
    assert [x.get("id") for x in found if x.tag.endswith("}node")] == ["a", "b<c"] and [(x.get("source"), x.get("target")) for x in found if x.tag.endswith("}edge")] == [("a", "b<c")]
    items = spark.createDataFrame([("f", 5, "function", "k://1"), ("f", 9, "class", "k://2"), ("e", 9, "class", "k://3"), (None, 99, "class", "k://4")], "path string, score long, kind string, stable_key string")
    assert [tuple(r) for r in R.change_files(items).collect()] == [("e", 9, ["class"], ["k://3"]), ("f", 9, ["class", "function"], ["k://1", "k://2"])]


def test_pagerank_with_cycle_as_power_iteration(spark):
    g = small(spark, [("a", "calls", "b"), ("b", "calls", "c"), ("c", "calls", "a"), ("c", "contains", "d"), ("c", "contains", "d2"), ("b", "imports", "c")])
    got = {r["id"]: r["score"] for r in G.pagerank(g).collect()}
    out = {"a": ["b"], "b": ["c", "c"], "c": ["a", "d", "d2"], "d": [], "d2": []}
    x = dict.fromkeys(out, 0.2)
    for _ in range(200):
        rest = (0.15 + 0.85 * sum(x[i] for i in x if not out[i])) / 5
        x = {i: rest + 0.85 * sum(x[j] * out[j].count(i) / len(out[j]) for j in x if out[j]) for i in x}
    assert got == pytest.approx(x, abs=1e-7)


def test_cycles(spark):
    g = small(spark, [("a", "calls", "b"), ("b", "calls", "a"), ("b", "calls", "c"), ("c", "calls", "a"), ("d", "calls", "d"), ("d", "calls", "a")])
    assert [(r["length"], r["relations"]) for r in G.cycles(g).collect()] == [(1, ["d-calls-d"]), (2, ["a-calls-b", "b-calls-a"]), (3, ["a-calls-b", "b-calls-c", "c-calls-a"])]


def test_impact_directions(spark):
    g = small(spark, [("a", "calls", "b"), ("b", "tested_by", "t"), ("x", "uses_env", "b"), ("m", "contains", "a")])
    hit = {r["id"]: (r["depth"], r["path"]) for r in G.impact(g, spark.createDataFrame([("b",)], "id string")).collect()}
    assert hit == {"b": (0, []), "a": (1, ["a-calls-b"]), "t": (1, ["b-tested_by-t"]), "m": (2, ["a-calls-b", "m-contains-a"])}


def test_pagerank_sums_to_one(spark):
    g = small(spark, [("a", "calls", "b"), ("a", "calls", "c"), ("b", "calls", "c")])
    rows = G.pagerank(g, limit=3).collect()
    assert [r["id"] for r in rows] == ["c", "b", "a"] and abs(sum(r["score"] for r in rows) - 1) < 1e-9


def test_change_map_and_diversity(spark):
    assert R.diversified([("a", "f"), ("b", "f"), ("c", "g"), ("d", None)], 3) == {"a", "b", "c"}
    g = small(spark, [("a", "calls", "b"), ("b", "contains", "c")])
    rows = R.change_map(g, spark.createDataFrame([("a", 1200, "target")], "id string, score long, reasons string"), 2, 10).collect()
    assert [(r["id"], r["score"]) for r in rows] == [("a", 1200), ("b", 1200 - 100 + 90 + 10), ("c", 1200 - 200 + 100 + 40)]


def test_context_pack(spark):
    g = small(spark, [("alpha", "calls", "beta")])
    rows = R.context_pack(g, "alpha").collect()
    assert [r["id"] for r in rows] == ["alpha", "beta"] and rows[0]["confidence"] == 1.0
    assert not R.context_pack(g, "nothing").collect()
    assert R.estimated_tokens([10], [], []) == 5 and R.estimated_tokens([10, 10], [3], []) == 9


def test_small_plans(spark):
    assert planned_scope([{"add": "dependency_closure", "change": "file_local"}], True, False) == "dependency_closure"
    assert planned_scope([{"add": "dependency_closure", "change": "file_local"}, {}], False, True) == "global"
    s = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "id string, seq int")
    assert {r["id"] for r in retention(s, 2, "s1").where("kept").collect()} == {"s1", "s3"}
    a = spark.createDataFrame([("x", "1", None), ("y", "1", None)], "path string, content_hash string, language_hint string")
    b = spark.createDataFrame([("x", "1", None), ("y", "1", "md"), ("z", "1", None)], "path string, content_hash string, language_hint string")
    assert {tuple(r) for r in classify(a, b).collect()} == {("x", "unchanged"), ("y", "changed"), ("z", "changed")}
    assert porcelain("R  new\0old\0 M m\0 D d\0") == [("old", "removed"), ("new", "changed"), ("m", "changed"), ("d", "removed")]


def test_markdown():
    rows = out(markdown.extract, "docs/a.md", "---\nid: x\nkind: runbook\nentities: [env://A]\n---\n# Top\n\n## Über uns\n```\n# no\n```\nTwo\n---\n## Two\n1. do A\n2. do B\n", "markdown")
    assert list(by_kind(rows, "documentation_section")) == ["doc://x#top", "doc://x#%C3%BCber-uns", "doc://x#two", "doc://x#two-2"]
    assert by_kind(rows, "documentation_page")["doc://x"]["entities"] == ["env://A"]
    assert [p["sequence"] for p in by_kind(rows, "operation_step").values()] == [1, 2]


def test_rust():
    text = 'use crate::b::{self, C as D, e::*};\nmod inner { pub fn deep() { super::top(1); } }\npub struct S;\nimpl S { fn go(&self) { Self::new(); b::run(); "fn no() {}"; } fn new() {} }\nfn top(x: u8) { std::env::var("HOME"); }\n#[test]\nfn checks() { top(2); }\n'
    rows = out(rust.extract, "crates/my-app/src/a.rs", text, "rust")
    assert by_kind(rows, "module")["symbol://rust:my_app::a"]["imports"] == ["crate::b", "crate::b::C", "crate::b::e::*"]
    f = by_kind(rows, "function")
    assert set(f) == {f"symbol://rust:my_app::a::{x}" for x in ("inner::deep", "S::go", "S::new", "top")}
    assert f["symbol://rust:my_app::a::inner::deep"]["calls"] == ["super::top"] and "b::run" in f["symbol://rust:my_app::a::S::go"]["calls"]
    assert by_kind(rows, "test_case")["symbol://rust:my_app::a::checks"]["calls"] == ["top"] and "env://HOME" in by_kind(rows, "env_var")


def test_javascript():
    rows = out(javascript.extract, "web/a.ts", 'import x from "./b";\nexport const f = async (a) => { return 1; };\nexport default class K { go() {} }\ntype T = string;\n// import y from "./no"\n', "typescript")
    assert by_kind(rows, "module")["module://js-ts:web/a.ts"]["imports"] == ["./b"]
    assert {"symbol://js-ts:web/a.ts#f", "symbol://js-ts:web/a.ts#K.go"} == set(by_kind(rows, "function"))
    assert [r["kind_other"] for r in out(javascript.extract, "a.js", "function f( {", "javascript") if r["table"] == "diagnostics"] == ["js_ts_parse_error"]


CONTRACT = {
    "openapi": "3.0.0", "security": [{"key": []}], "paths": {"/login/{id}": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "string"}}], "post": {"operationId": "login", "tags": ["auth"], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/In"}, "example": {"name": 1}}}}, "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Gone"}}}}}}}},
    "components": {"schemas": {"In": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}}, "securitySchemes": {"key": {"type": "http", "scheme": "bearer"}}},
}


def test_openapi_same_in_both_formats():
    import yaml

    a = out(openapi.extract, "api.json", json.dumps(CONTRACT), "json")
    b = out(openapi.extract, "api.json", yaml.safe_dump(CONTRACT), "yaml")
    assert a == b
    late = json.dumps({"components": {"schemas": {f"S{i}": {"type": "object"} for i in range(500)}}, "openapi": "3.0.0", "paths": {}})
    assert late.index("openapi") > 4000 and openapi.supports(Source("late.json", "json", "h", late))
    p = by_kind(a, "api_endpoint")["api://POST:/login/{id}"]
    assert p["request_schemas"] == ["#/components/schemas/In"] and p["authentication_required"] and p["parameters"][0]["required"] and p["request_fields"] == [{"name": "name", "type": "string", "required": True}]


def test_graphql():
    rows = out(graphql.extract, "q.graphql", "query Login($id: ID!, $x: Int) { user(id: $id) { ...F ... on Admin { a } } }\nfragment F on User { name }\ntype Query { user(id: ID!): User! }\ntype User implements A & B @key { name: [String!]! }\nunion U = | A | B\n", "graphql")
    q = by_kind(rows, "api_endpoint")["api://GRAPHQL_QUERY:Login"]
    assert q["selection_roots"] == ["user"] and q["fragment_spreads"] == ["F"] and q["variables"] == ["id"] and [v["name"] for v in q["variable_definitions"]] == ["id", "x"] and q["inline_type_conditions"] == ["Admin"]
    s = by_kind(rows, "api_schema")
    assert s["api-schema://graphql:q.graphql#User"]["member_types"] == [{"name": "name", "type": "[String!]!"}] and s["api-schema://graphql:q.graphql#U"]["fields"] == ["A", "B"]


@pytest.mark.parametrize(
    ("f", "path", "text", "hint", "kind", "keys"),
    [
        ("env", ".env", "A=1\n#B=2\nexport C=\n", None, "env_var", {"env://A", "env://C"}),
        ("makefile", "Makefile", "all: b\n\techo\nV := 1\n", None, "script_command", {"script-command://Makefile#target:all"}),
        ("cargo", "Cargo.toml", '[package]\nname = "x"\n[dependencies]\ny = "1"\n', "toml", "dependency", {"dependency://cargo:y"}),
        ("dockerfile", "Dockerfile", "FROM a AS build\nRUN x \\\n y\n", None, "docker_service", {"docker://Dockerfile#build"}),
        ("shell", "a.sh", "go() {\n}\nfunction up {\n}\n", "shell", "script_command", {"script-command://a.sh#function:go", "script-command://a.sh#function:up"}),
        ("compose", "compose.yml", "services:\n  web:\n    image: i\n    environment: [A=1]\n", "yaml", "docker_service", {"docker://compose.yml#web"}),
        ("kubernetes", "k.yaml", "apiVersion: v1\nkind: Pod\nmetadata: {name: p}\nspec: {containers: [{name: c, command: [x], env: [{name: E}]}]}\n", "yaml", "env_var", {"env://E"}),
        ("migration", "migrations/1.sql", 'CREATE TABLE IF NOT EXISTS "s"."t" (id int); -- CREATE TABLE no\n', "sql", "db_table", {"db-table://s.t"}),
        ("configuration", "config/a.toml", "[a]\nb = 1\n", "toml", "feature", {"config://config/a.toml#a.b"}),
        ("workflow", ".github/workflows/ci.yml", "name: ci\njobs:\n  t:\n    steps:\n      - run: x\n", "yaml", "ci_job", {"ci-job://.github/workflows/ci.yml#t"}),
    ],
)
def test_operations(f, path, text, hint, kind, keys):
    assert set(by_kind(out(getattr(operations, f), path, text, hint), kind)) == keys


def test_schema_errors():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2, "exclusiveMinimum": True}}, "additionalProperties": False}
    assert C.schema_errors({"a": 3}, s) == [] and C.schema_errors({"a": 2}, s) == ["$.a: too small"]
    assert set(C.schema_errors({"b": 1}, s)) == {"$.a: missing", "$.b: not allowed"} and C.schema_errors(None, {"type": ["string", "null"]}) == []


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "api.json": json.dumps(CONTRACT), "crates/app/src/lib.rs": "pub mod auth;\nuse crate::auth::login;\n#[test]\nfn t() { login(); }\n", "crates/app/src/auth.rs": "pub fn login() {}\n",
        "docs/login.md": "---\nid: login\nentities: ['api://POST:/login/{id}', 'api://none']\n---\n# Login\n## Steps\n", "docs/empty.md": "text\n", "node_modules/x.js": "no", "q.graphql": "query Login { user { ...F ...G } }\nfragment F on User { name }\n",
        "web/a.ts": 'import b from "./lib";\n', "web/lib/index.ts": "export function b() {}\n", ".env": "SECRET=1\n",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_index_end_to_end(spark, repository, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = scan(spark, f"file://{repository}")
    assert files.where("path like 'node_modules%'").isEmpty()
    assert files.where("path = 'docs/empty.md'").first()["content_hash"] == "fnv1a64:" + fnv("text\n")
    first = index(store, files)
    g = store.read()
    k = {r["id"]: r["stable_key"] for r in g.entities.collect()}
    assert k == {i: v for i, v in k.items() if i == f"ent_{fnv(v)}"}
    rel = {((r["kind_other"] or r["kind"]), k[r["src"]], k[r["dst"]]) for r in g.relations.collect()}
    assert ("tested_by", "symbol://rust:app::auth::login", "symbol://rust:app::t") in rel and ("implemented_by", "api://POST:/login/{id}", "symbol://rust:app::auth::login") in rel
    assert ("documents", "doc://login", "api://POST:/login/{id}") in rel and ("imports", "module://js-ts:web/a.ts", "module://js-ts:web/lib/index.ts") in rel
    assert ("documents_api", "doc://login", "api://POST:/login/{id}") in rel and ("schema_for_request", "api://POST:/login/{id}", "api-schema://api.json#In") in rel
    found = {(r["kind_other"] or r["kind"], k.get(r["entities"][0])) for r in g.diagnostics.collect()}
    assert {("documentation_page_missing_title", "doc://docs/empty.md"), ("documentation_reference_unresolved", "doc://login"), ("api_response_schema_mismatch", "api://POST:/login/{id}"), ("missing_documentation", "env://SECRET"), ("graphql_fragment_unresolved", "api://GRAPHQL_QUERY:Login")} <= found
    assert any(kind == "api_example_invalid" for kind, _ in found)
    assert index(store, files).reused
    (repository / "docs/empty.md").write_text("# Now\n## Part\n")
    second = index(store, scan(spark, f"file://{repository}"))
    assert (second.snapshot, second.files["changed"]) == ("snap_0002", 1) and first.snapshot == "snap_0001"
    full = MemoryStore(spark)
    index(full, scan(spark, f"file://{repository}"))
    for t in ("entities", "facts", "relations", "diagnostics"):
        assert {r["id"] for r in getattr(store.read(), t).select("id").collect()} == {r["id"] for r in getattr(full.read(), t).select("id").collect()}


@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_store_life_cycle(spark, tmp_path, kind):
    s = Store(spark, f"file://{tmp_path}/s") if kind == "parquet" else MemoryStore(spark)
    assert s.read().entities.isEmpty()
    with pytest.raises(NotCommitted):
        s.read("snap_9999")
    g, one = small(spark, [("a", "calls", "b")]), s.begin()
    s.put(one, g)
    assert s.latest() is None
    s.commit(one)
    assert s.read().entities.count() == 2
    with pytest.raises(ValueError):
        s.put(one, g)
    with pytest.raises(ValueError):
        s.abort(one)
    two = s.begin()
    with pytest.raises(ValueError):
        s.put(two, g.with_tables(relations=g.relations.withColumn("evidence", F.array().cast(g.relations.schema["evidence"].dataType))))
    s.abort(two)
    s.put(two, g)
    s.commit(two)
    assert [n for n, _ in s.list()] == [two, one] and s.latest() == two
    if kind == "parquet":
        assert s.prune(1, dry_run=True) == [one] and s.prune(1) == [one] and [n for n, _ in s.list()] == [two]


def test_watch(spark, repository, tmp_path):
    from graphloom.streaming.index import watch

    store, runs = MemoryStore(spark), []
    watch(spark, f"file://{repository}", store, f"file://{tmp_path}/cp", Registry().only(extractors=["markdown"], linkers=["linker-markdown"], checkers=[]), done=lambda e, r: runs.append(r), once=True).awaitTermination()
    assert len(runs) == 1 and store.latest() == "snap_0001"


def test_entity_merge_takes_contract_fields(spark):
    row = lambda path, title, n: (f"{n}", "e", "k", title, {"path": path, "line_start": 1, "line_end": 1}, n)
    df = spark.createDataFrame([row("contracts/a", "A", 1), row("src/a", None, 2)], "name string, id string, stable_key string, title string, source struct<path:string,line_start:int,line_end:int>, seq int")
    df = df.withColumns({"snapshot": F.lit("s"), "kind": F.lit("x"), "kind_other": F.lit(None).cast("string"), "language": F.lit(None).cast("string"), "aliases": F.array().cast("array<string>"), "ownership": F.array(F.struct(F.col("source.path").alias("source_file"))), "payload": F.lit("{}")})
    r = merge_entities(df).first()
    assert (r["name"], r["title"], r["source"]["path"], len(r["ownership"])) == ("1", "A", "contracts/a", 2)


def test_rust_candidates(spark):
    df = spark.range(1).select(F.transform(L.candidates(F.lit("app::a"), F.array(F.lit("crate::b::run"), F.lit("crate::c::*")), F.lit("run")), lambda s: s["key"]).alias("c"))
    assert df.first()["c"] == ["app::a::run", "app::b::run", "app::c::run", "run"]


def test_extract_reports_failures(spark):
    from graphloom.sources.extract import Extractor

    def broken(src, out):
        raise ValueError

    files = spark.createDataFrame([("a.md", "markdown", "h", "# A")], "path string, language_hint string, content_hash string, content string")
    g = extract(files, "s", [Extractor("bad", lambda s: True, broken)])
    assert [r["kind_other"] for r in g.diagnostics.collect()] == ["extraction_failed"] and g.entities.count() == 1
