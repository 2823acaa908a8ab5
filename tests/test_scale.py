"""What must not grow faster than the input: what is written, joined, and kept by one task."""

from graphloom.sources import testdata


def staged_by(monkeypatch, module):
    """Names of the tables that a module stages from now on."""
    names, plain = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: (names.append(name), plain(df, name))[1])
    return names


def test_projection_writes_only_pairs(spark, sf, monkeypatch):
    names = staged_by(monkeypatch, testdata)
    monkeypatch.setattr(testdata, "_SNAPSHOTS", {})
    g = testdata.graph(spark, sf)
    assert g.with_tables(facts=g.entities).facts.count() and names == []
    plan = g.entities.where("kind = 'class'").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" in plan and "o_orderkey" not in plan
    h = g.with_tables(entities=g.entities.limit(1))
    assert h.relations.count() and g.relations.count() and names == ["pairs", "pairs"]


def test_fnv_of_batches():
    import pyarrow as pa

    from graphloom.functions.text import fnv_of
    from graphloom.sources.extract import fnv

    xs = [None, "", "é" * 50] + ["ab" * k for k in range(60)]
    assert fnv_of(pa.array(xs, pa.string()).slice(1)).to_pylist() == [fnv(x) for x in xs[1:]] and fnv_of(pa.array(xs)).to_pylist()[0] is None


def test_text_contains_looked_up_or_joined(spark):
    from graphloom.operators.link import documents_endpoints
    from graphloom.queries.rules import entities, graph_of

    texts = spark.createDataFrame([(1, "one getParts two"), (2, "x" * 40000), (3, "get part é"), (4, "a")], "k int, t string")
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["getParts", "xxxx", "rté", "none"])], "k int, t string")
    g = graph_of(spark, [entities(texts, "documentation_page", "concat('doc:', k)", "to_json(named_struct('text', t))", "''", "'p'"), entities(words, "api_endpoint", "concat('end:', k)", "to_json(named_struct('operation_id', t))", "''", "'p'")])
    want = [("doc:1", "end:0"), ("doc:2", "end:1"), ("doc:3", "end:2")]
    for most in (100, 1):
        assert sorted(tuple(r) for r in documents_endpoints(g, most).select("src", "dst").collect()) == want


def test_index_of_paths_broadcasts_hot_ones(spark, sf):
    from graphloom.operators.aggregate import path_index

    assert "strategy=broadcast" in path_index(testdata.graph(spark, sf), 50)._jdf.queryExecution().optimizedPlan().toString()


def test_memory_store_caches_nothing(spark, sf):
    from graphloom.sinks.store import MemoryStore

    spark.catalog.clearCache()
    store = MemoryStore(spark)
    store.put("s", testdata.graph(spark, sf))
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_owners_are_told_before_rows_move(spark, sf):
    from graphloom.operators.query import owned_by

    r = testdata.graph(spark, sf).relations
    none, some = (spark.createDataFrame([(p,)], "path string") for p in ("docs/none", "edges/calls"))
    assert owned_by(r, none, keep=False) is r and owned_by(r, none).count() == 0
    assert owned_by(r, some).count() == r.where("kind = 'calls'").count()


def test_either_end_joins_twice(spark):
    from graphloom.operators.link import either_end

    r = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "c", "d"), ("r4", "a", "a")], "id string, src string, dst string")
    out = either_end(r, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert sorted(x["id"] for x in out.collect()) == ["r1", "r2", "r4"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_cycles_walk_from_their_least_start(spark, monkeypatch):
    from graphloom.operators import graph as G
    from graphloom.queries.rules import entities, graph_of, relations

    n = spark.createDataFrame([(str(i), str((i + 1) % 4)) for i in range(4)] + [("4", "4")], "s string, t string")
    g = graph_of(spark, [entities(n, "symbol", "s")], [relations(n, "calls", "s", "t")])
    seen, plain = [], G.stage
    monkeypatch.setattr(G, "stage", lambda df, name: (out := plain(df, name), seen.append((name, out.count())))[0])
    assert sorted(r["length"] for r in G.cycles(g, max_starts=None, limit=None).collect()) == [1, 4]
    assert sum(k for name, k in seen if name == "paths") <= 10
    assert [r["length"] for r in G.cycles(g, max_starts=1, limit=None).collect()] == [4]


def test_read_model_is_packed(spark, sf, tmp_path):
    from graphloom.sinks.store import read_model, write_read_model

    g = testdata.graph(spark, sf)
    write_read_model(g, f"file://{tmp_path}/m")
    assert list(tmp_path.glob("m/relations/*.json.gz")) and not list(tmp_path.glob("m/relations/*.json"))
    assert read_model(spark, f"file://{tmp_path}/m").relations.count() == g.relations.count()


def test_graph_view_ranks_nodes_once(spark, sf, monkeypatch):
    from graphloom.sinks import render

    names = staged_by(monkeypatch, render)
    render.graph_view(testdata.graph(spark, sf))
    assert names == ["nodes"]


def rows_staged(monkeypatch, module):
    """(name, rows) of the tables that a module stages from now on."""
    seen, plain = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: (out := plain(df, name), seen.append((name, out.count())))[0])
    return seen


def small_graph(spark, nodes, edges):
    from graphloom.queries.rules import entities, graph_of, relations

    n = spark.createDataFrame([(x,) for x in nodes], "s string")
    e = spark.createDataFrame(edges, "s string, t string")
    return graph_of(spark, [entities(n, "symbol", "s")], [relations(e, "calls", "s", "t")])


def test_bundle_looks_up_keys_of_shown_modules_only(spark, sf, monkeypatch):
    from graphloom.sinks import render

    seen = rows_staged(monkeypatch, render)
    g = testdata.graph(spark, sf)
    render.architecture_bundle(g, spark.createDataFrame([("nation://3", 1), ("nation://none", 0)], "module string, score int"))
    want = g.relations.where("src = 'nation:3' or dst = 'nation:3'").count()
    assert seen[0] == ("near", want) and 0 < want == seen[1][1] - 1


def test_path_keeps_ways_of_the_path_only(spark, monkeypatch):
    from graphloom.operators import graph as G

    leaves = [f"l{i}" for i in range(40)]
    g = small_graph(spark, ["a", "b", "c", "d", *leaves], [("a", "c"), ("c", "d"), ("b", "d"), *(("a", x) for x in leaves), *((x, "gone") for x in leaves)])
    seen = rows_staged(monkeypatch, G)
    ids = {r["stable_key"]: r["id"] for r in g.entities.collect()}
    a, b = "a", "b"
    assert [(r["hop"], r["src"], r["dst"]) for r in G.shortest_path(g, a, b, 6, None).collect()] == [(1, ids["a"], ids["c"]), (2, ids["c"], ids["d"]), (3, ids["d"], ids["b"])]
    assert sum(n for name, n in seen if name == "way") == 4
    assert not G.shortest_path(g, a, b, 2, None).collect()


def test_pagerank_hands_on_once_without_cycles(spark, monkeypatch):
    from graphloom.operators import graph as G

    nodes, edges = list("abcdef"), [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "gone"), ("gone", "e")]
    known = [(s, t) for s, t in edges if "gone" not in (s, t)]
    score = dict.fromkeys(nodes, 1 / 6)
    for _ in range(200):
        outs = {n: sum(s == n for s, _ in known) for n in nodes}
        rest = (0.15 + 0.85 * sum(score[n] for n in nodes if not outs[n])) / 6
        score = {n: rest + 0.85 * sum(score[s] / outs[s] for s, t in known if t == n) for n in nodes}
    g = small_graph(spark, nodes, edges)
    keys = {r["id"]: r["stable_key"] for r in g.entities.collect()}
    seen = rows_staged(monkeypatch, G)
    got = {keys[r["id"]]: r["score"] for r in G.pagerank(g).collect()}
    assert got.keys() == score.keys() and all(abs(got[n] - score[n]) < 1e-9 for n in nodes)
    assert sum(n for name, n in seen if name == "term") == 0


def test_wiki_deals_rows_out_once(spark, sf):
    """Rows of each end are dealt out by the end whose key is looked up, and once by node: not again for keys, nor for lists."""
    from graphloom.sinks.render import wiki_pages

    plan = wiki_pages(testdata.graph(spark, sf)).select("path", "text")._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window [row_number()")
    assert "Join LeftOuter" in plan[window:] and "Join" not in plan[plan.rindex("Aggregate", 0, window) : window]


def test_query_stems_its_own_words_only(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import rank as R

    d = spark.createDataFrame([("a", "Flies", "classes of supplied stories, running"), ("b", "fly", "class story run supply quickly"), ("c", "", None)], "id string, title string, body string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for q in ("fly story", "class supplying", "runs of y", ""):
        whole, few = R.postings(d, True), R.postings(d, True, q)
        assert rows(few[0].where(F.col("term").isin(*R.asked(spark, q, True), ""))) == rows(whole[0].where(F.col("term").isin(*R.asked(spark, q, True), "")))
        assert rows(R.bm25(few, q, None, True)) == rows(R.bm25(whole, q, None, True))
    assert {r["term"] for r in R.postings(d, True, "fly story")[0].collect()} == {"fly", "story"}


def test_tests_are_looked_up_for_shown_rows_only(spark, monkeypatch):
    from graphloom.operators import rank as R

    g = small_graph(spark, list("abcdef"), [("a", "b"), ("c", "d"), ("d", "e"), ("e", "f")])
    seen, plain = [], R.tests_per_entity
    monkeypatch.setattr(R, "tests_per_entity", lambda h: (seen.append(h.relations.count()), plain(h))[1])
    seeds = spark.createDataFrame([("a", 1200, "target")], "id string, score long, reasons string")
    assert R.change_map(g, seeds, 2, 30).count() == 2 and seen == [1]


def test_closure_walks_packed_ids(spark, sf, monkeypatch):
    from graphloom.operators import graph as G

    # A start that is no end, ends that are no entities, numbers that are not written plainly, a null end.
    edges = [(1, 2), (3, 2), (3, 4), (5, 6), (6, 5), (8, None), (9, 9)]
    forms = {"long": lambda i: f"ent_{i * 0x1FFFFFFFFFFFFFFF % 2**64:016x}", "number": lambda i: f"{'nm'[i % 2]}:{i}", "mixed": lambda i: f"n:0{i}" if i == 4 else f"n:{i}", "plain": lambda i: f"x{i}"}
    monkeypatch.setattr(G, "reached", lambda *a, plain=G.reached, **k: (walked.append(1), plain(*a, **k))[1])
    for name, form in forms.items():
        walked = []
        nodes = [form(i) for i in (1, 2, 3, 5, 6, 8, 9)]
        g = small_graph(spark, nodes, [(form(s), None if t is None else form(t)) for s, t in edges])
        for starts, want in (([2], [1, 2, 3, 4]), ([5, 7, 9], [5, 6, 7, 9]), ([8], [8]), ([], [])):
            got = [r["id"] for r in G.closure(g, spark.createDataFrame([(form(i),) for i in starts], "id string")).collect()]
            assert sorted(got) == sorted(map(form, want)), name
        assert bool(walked) == (name in ("mixed", "plain"))
    names = staged_by(monkeypatch, testdata)
    monkeypatch.setattr(testdata, "_SNAPSHOTS", {})
    g = testdata.graph(spark, sf)
    assert {r["id"] for r in G.closure(g, spark.createDataFrame([("document:7",)], "id string")).collect()} > {"document:7", "part:7"} and names == []
    assert g.with_tables(relations=g.relations.limit(1)).ends.count() == 1 and g.with_tables(facts=g.facts).ends.distinct().count() == g.relations.select("src", "dst").distinct().count()


def test_files_of_one_row_group_are_dealt_out(spark, sf):
    from pyspark.sql import functions as F

    from graphloom.queries.files import sources
    from graphloom.sources.extract import fnv, run
    from graphloom.sources.extractors import EXTRACTORS

    assert testdata.read(spark, sf, "part").rdd.getNumPartitions() == 1
    rows = run(sources(spark, sf), list(EXTRACTORS)).where("kind in ('module', 'db_migration', 'documentation_page')")
    spread = [r["kind"] for r in rows.select("kind", F.spark_partition_id().alias("part")).distinct().collect()]
    assert all(spread.count(k) > 1 for k in ("module", "documentation_page"))
    f = run(sources(spark, sf).where("path = 'src/part1.ts'"), list(EXTRACTORS)).where("table = 'facts'").collect()
    assert len(f) == 4 and all(r["id"] == "fact_" + fnv("\0".join((r["kind"], r["subject"], r["object"], r["path"], str(r["line_start"]), r["value"]))) for r in f)


def test_parts_of_one_row_group_are_dealt_out(spark, sf):
    from graphloom.queries import rules

    assert testdata.read(spark, sf, "part").rdd.getNumPartitions() == 1 < rules.parts(spark, sf).rdd.getNumPartitions()
    assert "ArrowEvalPython" not in rules.rule_rust_tested_by(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
