"""Aggregations over a snapshot: overview, coverage, capabilities and roll-ups.

All are hash aggregates with map-side partial sums. A result that only lists the top keeps the number of what it
leaves out in ``omitted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.kinds import display_kind, percent, severity_rank
from graphloom.functions.text import anchor, source_root
from graphloom.model import KnowledgeGraph

OPERATION_KINDS = ("script", "script_command", "env_var", "docker_service", "ci_job", "db_migration")
#: Adapters whose facts say only that a file exists: they don't count as having processed it.
BASELINE = ("file",)


def _paths(column: str) -> Column:
    return F.coalesce(F.col(f"{column}.source_file"), F.array().cast("array<string>"))


def overview_totals(g: KnowledgeGraph) -> DataFrame:
    """One row: sizes of the four tables, open diagnostics and files."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    d = g.diagnostics.agg(F.count("*").alias("diagnostics"), F.count_if(F.col("status") == "open").alias("open_diagnostics"))
    return one(g.entities, "entities").crossJoin(one(g.facts, "facts")).crossJoin(one(g.relations, "relations")).crossJoin(d).crossJoin(one(g.file_state, "files"))


def top_counts(df: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """(value, n): commonest first, ties by value."""
    out = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), "value").limit(limit)


def kind_counts(g: KnowledgeGraph, table: str = "entities", limit: int | None = None) -> DataFrame:
    return top_counts(getattr(g, table), display_kind("overview"), limit)


def source_roots(g: KnowledgeGraph, limit: int | None = None) -> DataFrame:
    return top_counts(g.entities.where("source.path is not null"), source_root(F.col("source.path")), limit)


def api_overview(g: KnowledgeGraph, endpoint_kind: str = "api_endpoint", schema_kind: str = "api_schema", example_kind: str = "api_example") -> DataFrame:
    """One row: endpoints, schemas, examples, and endpoints with a document and with an implementation."""
    e = g.entities.select("id", display_kind().alias("k")).where(F.col("k").isin(endpoint_kind, schema_kind, example_kind))
    documented = g.relations.where(F.col("kind").isin("documents", "documents_api", "documents_operation")).select(F.col("dst").alias("id")).distinct().withColumn("documented", F.lit(True))
    implemented = g.relations.where("kind = 'implemented_by'").select(F.col("src").alias("id")).distinct().withColumn("implemented", F.lit(True))
    is_endpoint = F.col("k") == endpoint_kind
    return e.join(documented, "id", "left").join(implemented, "id", "left").agg(
        F.count_if(is_endpoint).alias("endpoints"),
        F.count_if(F.col("k") == schema_kind).alias("schemas"),
        F.count_if(F.col("k") == example_kind).alias("examples"),
        F.count_if(is_endpoint & F.col("documented")).alias("documented_endpoints"),
        F.count_if(is_endpoint & F.col("implemented")).alias("implemented_endpoints"),
    )


def docs_overview(g: KnowledgeGraph, operations_prefix: str = "docs/operations/") -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return g.entities.agg(
        n("documentation_page").alias("pages"),
        n("documentation_section").alias("sections"),
        n("runbook").alias("runbooks"),
        n("operation_step").alias("steps"),
        F.count_if((F.col("kind") == "documentation_page") & F.coalesce(F.col("source.path"), F.lit("")).startswith(operations_prefix)).alias("operations_pages"),
    )


def operations_overview(g: KnowledgeGraph, kinds: tuple[str, ...] = OPERATION_KINDS) -> DataFrame:
    """One row with a count for each kind."""
    return g.entities.where(F.col("kind").isin(*kinds)).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def first_ids(ids: Column, limit: int) -> Column:
    return F.slice(F.array_sort(ids), 1, limit)


def limited_ids(df: DataFrame, keys: list[str], limit: int, out: str = "relations") -> DataFrame:
    """For each key: ``n`` rows, and the first ``limit`` ids in order.

    Ranks are cut before they are collected, so that a key of any size gathers ``limit`` ids at most.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("id")
    few = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias(out))
    return n.join(few, keys)


def module_structure(g: KnowledgeGraph, limit: int = 20, module_kind: str = "module") -> DataFrame:
    """For each module: outgoing defines and contains, the first ids of them, and how many are left out."""
    m = g.entities.where(display_kind() == module_kind).select(F.col("id").alias("module"), "stable_key", "name")
    own = limited_ids(g.relations.where("kind in ('defines', 'contains')").select(F.col("src").alias("module"), "id"), ["module"], limit)
    n = F.coalesce("n", F.lit(0).cast("long"))
    ids = F.coalesce("relations", F.array().cast("array<string>"))
    return m.join(own, "module", "left").select("module", "stable_key", "name", n.alias("n_relations"), ids.alias("relations"), (n - F.size(ids)).alias("omitted"))


def crossing(g: KnowledgeGraph) -> DataFrame:
    """(id, kind, from_root, to_root) of the relations whose ends lie in different source roots."""
    root = g.entities.where("source.path is not null").select("id", source_root(F.col("source.path")).alias("root"))
    r = g.relations.select("id", display_kind("overview").alias("kind"), "src", "dst")
    return r.join(root.toDF("src", "from_root"), "src").join(root.toDF("dst", "to_root"), "dst").where("from_root <> to_root").select("id", "kind", "from_root", "to_root")


def boundaries(g: KnowledgeGraph, limit: int | None = None) -> DataFrame:
    """(from_root, to_root, n, kinds): relations that cross source roots; kinds as ``kind=n``, most first."""
    by_kind = crossing(g).groupBy("from_root", "to_root", "kind").agg(F.count("*").alias("n"))
    one = F.struct((-F.col("n")).alias("o"), "kind", "n")
    out = by_kind.groupBy("from_root", "to_root").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(one)).alias("ks"))
    out = out.select("from_root", "to_root", "n", F.array_join(F.transform("ks", lambda k: F.concat_ws("=", k["kind"], k["n"].cast("string"))), ",").alias("kinds"))
    return out if limit is None else out.orderBy(F.desc("n"), "from_root", "to_root").limit(limit)


def degrees(g: KnowledgeGraph) -> DataFrame:
    """(id, n_in, n_out, degree) of every end of a relation; a self-loop counts twice."""
    ends = g.relations.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def overview_hubs(g: KnowledgeGraph, limit: int = 10) -> DataFrame:
    """Known entities of highest degree; ties by stable key."""
    e = g.entities.select("id", "stable_key", display_kind("overview").alias("kind"), "name")
    return degrees(g).select("id", "degree").join(e, "id").orderBy(F.desc("degree"), "stable_key").limit(limit)


def open_diagnostics(g: KnowledgeGraph, limit: int | None = None) -> DataFrame:
    """Open diagnostics, worst first, with the place of their first evidence."""
    first = F.try_element_at("evidence", F.lit(1))
    out = g.diagnostics.where("status = 'open'").select("id", display_kind().alias("kind"), "severity", "title", F.when(first["source_file"].isNotNull(), anchor(first["source_file"], first["line_start"])).alias("anchor"), severity_rank().alias("rank"))
    return (out if limit is None else out.orderBy("rank", "kind", "id").limit(limit)).drop("rank")


def coverage_observations(g: KnowledgeGraph) -> DataFrame:
    """(path, adapter, entity, fact, relation, diagnostic, opened): what each table says of each file, one row for each pair."""
    none = F.lit(None).cast("string")

    def row(df: DataFrame, paths: Column, adapter: Column, **ones: Column) -> DataFrame:
        marks = [ones.get(k, F.lit(0)).cast("long").alias(k) for k in ("entity", "fact", "relation", "diagnostic", "opened")]
        return df.select(F.explode(paths).alias("path"), adapter.alias("adapter"), *marks)

    one = F.lit(1)
    entity_paths = F.array_distinct(F.concat(_paths("ownership"), F.array("source.path")))
    ev = lambda df: df.withColumn("ev", F.explode("evidence"))
    parts = [
        row(g.entities, F.array_compact(entity_paths), none, entity=one),
        row(g.facts, F.array_distinct(F.concat(_paths("ownership"), F.array_compact(_paths("evidence")))), F.col("extractor"), fact=one),
        row(ev(g.relations), F.array(F.col("ev.source_file")), F.col("ev.extractor"), relation=one),
        row(g.diagnostics, F.array_distinct(F.concat(_paths("ownership"), F.array_compact(_paths("evidence")))), F.get(F.col("evidence.extractor"), F.lit(0)), diagnostic=one, opened=(F.col("status") == "open").cast("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("path is not null")


def coverage_files(g: KnowledgeGraph, limit: int | None = None) -> DataFrame:
    """For each tracked or observed file: counts of each table, open diagnostics, adapters. Files of which nothing is known are left out."""
    counts = ["entities", "facts", "relations", "diagnostics", "open_diagnostics"]
    seen = coverage_observations(g).groupBy("path").agg(
        *(F.sum(c).alias(n) for c, n in zip(("entity", "fact", "relation", "diagnostic", "opened"), counts, strict=True)), F.array_sort(F.collect_set("adapter")).alias("adapters")
    )
    tracked = g.file_state.select("path", F.lit(True).alias("tracked")).distinct()
    out = seen.join(tracked, "path", "full_outer").select(
        "path", F.coalesce("tracked", F.lit(False)).alias("tracked"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts), F.coalesce("adapters", F.array().cast("array<string>")).alias("adapters")
    )
    material = sum((F.col(n) for n in counts[:4]), F.lit(0))
    out = out.where(material > 0)
    return out if limit is None else out.orderBy(F.desc("open_diagnostics"), material.desc(), "path").limit(limit)


def coverage_adapters(g: KnowledgeGraph) -> DataFrame:
    """For each adapter: files, facts, relation evidence, diagnostics."""
    return (
        coverage_observations(g)
        .where("adapter is not null")
        .groupBy("adapter")
        .agg(F.count_distinct("path").alias("files"), F.sum("fact").alias("facts"), F.sum("relation").alias("relations"), F.sum("diagnostic").alias("diagnostics"))
    )


def coverage_diagnostics(g: KnowledgeGraph) -> DataFrame:
    """For each kind of diagnostic: all, open, files."""
    d = g.diagnostics.select(display_kind("debug").alias("kind"), "status", F.array_compact(F.array_distinct(F.concat(_paths("ownership"), _paths("evidence")))).alias("paths"))
    n = d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open"))
    files = d.select("kind", F.explode("paths").alias("p")).groupBy("kind").agg(F.count_distinct("p").alias("files"))
    return n.join(files, "kind", "left").select("kind", "n", "open", F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def coverage_totals(g: KnowledgeGraph) -> DataFrame:
    """Sums over all files: what lies in two files counts twice."""
    return coverage_files(g).agg(F.count("*").alias("files"), *(F.sum(n).alias(n) for n in ("entities", "facts", "relations", "diagnostics", "open_diagnostics")))


def processed_paths(g: KnowledgeGraph, baseline: tuple[str, ...] = BASELINE) -> DataFrame:
    """Distinct files of which any fact, relation evidence or diagnostic, not of a baseline adapter, tells."""
    told = F.col("fact") + F.col("relation") + F.col("diagnostic") > 0
    return coverage_observations(g).where(told & ~F.coalesce(F.col("adapter").isin(*baseline), F.lit(False))).select("path").distinct()


def capability_languages(g: KnowledgeGraph, baseline: tuple[str, ...] = BASELINE) -> DataFrame:
    """For each language hint of tracked files: files, processed, unprocessed, whole percent."""
    done = processed_paths(g, baseline).withColumn("done", F.lit(1).cast("long"))
    out = g.file_state.select("path", F.coalesce("language_hint", F.lit("unknown")).alias("language")).join(done, "path", "left").groupBy("language").agg(F.count("*").alias("tracked"), F.coalesce(F.sum("done"), F.lit(0).cast("long")).alias("processed"))
    return out.withColumn("unprocessed", F.col("tracked") - F.col("processed")).withColumn("percent", percent(F.col("processed"), F.col("tracked")))


def capability_adapters(g: KnowledgeGraph, threshold: float = 0.75) -> DataFrame:
    """For each extractor: files, facts, facts below the threshold, least confidence (1 at most)."""
    f = g.facts.select("extractor", "confidence", F.array_compact(F.array_distinct(F.concat(_paths("ownership"), _paths("evidence")))).alias("paths"))
    n = f.groupBy("extractor").agg(F.count("*").alias("facts"), F.count_if(F.col("confidence").cast("double") < threshold).alias("low_confidence"), F.least(F.lit(1.0).cast("float"), F.min("confidence")).alias("min_confidence"))
    files = f.select("extractor", F.explode("paths").alias("p")).groupBy("extractor").agg(F.count_distinct("p").alias("files"))
    return n.join(files, "extractor", "left").select(F.col("extractor").alias("adapter"), F.coalesce("files", F.lit(0).cast("long")).alias("files"), "facts", "low_confidence", "min_confidence")


def low_confidence(g: KnowledgeGraph, threshold: float = 0.75, limit: int | None = None) -> DataFrame:
    out = g.facts.where(F.col("confidence").cast("double") < threshold).select("id", F.col("extractor").alias("adapter"), display_kind("debug").alias("kind"), "subject", "confidence")
    return out if limit is None else out.orderBy("confidence", "adapter", "id").limit(limit)


def diagnostics_per_entity(g: KnowledgeGraph) -> DataFrame:
    """(entity, n, diagnostics): open diagnostics of each entity, by id."""
    d = g.diagnostics.where("status = 'open'").select("id", F.explode("entities").alias("entity")).distinct()
    return d.groupBy("entity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("diagnostics"))


def tests_per_entity(g: KnowledgeGraph, test_kind: str = "test_case") -> DataFrame:
    """(entity, tests): the tests at the other end of tested_by, covered_by_test and calls."""
    kinds = g.entities.select("id", (F.col("kind") == test_kind).alias("is_test"))
    r = g.relations.where("kind in ('tested_by', 'covered_by_test', 'calls')").join(kinds.toDF("src", "src_test"), "src").join(kinds.toDF("dst", "dst_test"), "dst").where("src_test <> dst_test")
    own = r.select(F.when(F.col("src_test"), F.col("dst")).otherwise(F.col("src")).alias("entity"), F.when(F.col("src_test"), F.col("src")).otherwise(F.col("dst")).alias("test")).distinct()
    return own.groupBy("entity").agg(F.array_sort(F.collect_list("test")).alias("tests"))


def adapter_metrics(runs: DataFrame) -> DataFrame:
    """Sums of (phase, adapter, ms, inputs, outputs, bytes) by phase and adapter; bytes stay null if none are known."""
    return runs.groupBy("phase", "adapter").agg(F.count("*").alias("runs"), F.sum("ms").alias("ms"), F.sum("inputs").alias("inputs"), F.sum("outputs").alias("outputs"), F.sum("bytes").alias("bytes"))


#: Ids of a row of the path index, about.
INDEXED = 10_000


def path_index(g: KnowledgeGraph, most: int = INDEXED) -> DataFrame:
    """(path, table, part, ids): which rows of each table a file owns. A file of many has several parts, dealt by the MD5 of
    the id, of about ``most`` ids each. Such files are at most one for ``most`` rows, so they are broadcast, and no row moves before its
    part is known."""
    rows = None
    for name in ("entities", "facts", "relations", "diagnostics"):
        own = getattr(g, name).select(F.explode(F.array_distinct(_paths("ownership"))).alias("path"), F.lit(name).alias("table"), "id")
        rows = own if rows is None else rows.union(own)
    parts = rows.groupBy("path", "table").agg((F.floor((F.count("*") - 1) / most) + 1).alias("parts"))
    hot = parts.where("parts > 1")
    number = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")
    dealt = rows.join(F.broadcast(hot), ["path", "table"], "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(number, F.col("parts"))).otherwise(F.lit(0)))
    return dealt.drop("parts").repartition("path", "table", "part").groupBy("path", "table", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def key_index(g: KnowledgeGraph) -> DataFrame:
    """(stable_key, ids)."""
    return g.entities.groupBy("stable_key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def api_counts(contract: DataFrame) -> DataFrame:
    """One row: endpoints, schemas and examples of a contract (class, ...)."""
    return contract.agg(*(F.count_if(F.col("class") == k).alias(f"{k}s") for k in ("endpoint", "schema", "example")))


def kind_pivot(g: KnowledgeGraph) -> DataFrame:
    """Relation kinds, and open diagnostics by severity, as one roll-up (group, value, n)."""
    r = g.relations.groupBy(display_kind().alias("value")).agg(F.count("*").alias("n")).withColumn("group", F.lit("relation"))
    d = g.diagnostics.where("status = 'open'").groupBy(F.col("severity").alias("value")).agg(F.count("*").alias("n")).withColumn("group", F.lit("severity"))
    return r.unionByName(d).select("group", "value", "n")


def surface_audit(g: KnowledgeGraph, layers: tuple[str, ...] = ("core", "transport", "ui")) -> DataFrame:
    """(module, surface, layers, files, met, total, percent): which layers each surface has.

    Surfaces have keys ``ffa_surface://module/surface``, layers ``ffa_layer://module/surface/role``.
    """
    parts = F.split(F.regexp_replace("stable_key", r"^[a-z_]+://", ""), "/")
    s = g.entities.where(F.col("stable_key").startswith("ffa_surface://")).select(parts[0].alias("module"), parts[1].alias("surface"))
    lay = g.entities.where(F.col("stable_key").startswith("ffa_layer://")).select("id", parts[0].alias("module"), parts[1].alias("surface"), parts[2].alias("role"))
    files = g.relations.where("kind = 'implemented_by'").select(F.col("src").alias("id"), "dst")
    own = lay.join(files, "id", "left").groupBy("module", "surface").agg(F.array_sort(F.collect_set("role")).alias("layers"), F.count_distinct("dst").alias("files"))
    wanted = F.array(*map(F.lit, layers))
    have = F.coalesce("layers", F.array().cast("array<string>"))
    met = F.size(F.array_intersect(have, wanted))
    return s.distinct().join(own, ["module", "surface"], "left").select("module", "surface", have.alias("layers"), F.coalesce("files", F.lit(0).cast("long")).alias("files"), met.alias("met"), F.lit(len(layers)).alias("total"), percent(met, F.lit(len(layers))).alias("percent"))


def contract_audit(g: KnowledgeGraph) -> DataFrame:
    """(module, met, unknown, total, percent): requirements of each module as its ``fba_requirement`` facts have them.

    A fact's value is {"requirement": name, "state": "met", "unmet" or "unknown"}; the last by id of a name counts.
    """
    m = g.entities.where(F.col("stable_key").startswith("fba_module://")).select(F.col("id").alias("subject"), F.regexp_replace("stable_key", "^fba_module://", "").alias("module"))
    f = g.facts.where("kind_other = 'fba_requirement'").select("subject", "id", F.get_json_object("value", "$.requirement").alias("r"), F.get_json_object("value", "$.state").alias("state"))
    f = f.groupBy("subject", "r").agg(F.max_by("state", "id").alias("state"))
    out = m.join(f, "subject", "left").groupBy("module").agg(F.count_if(F.col("state") == "met").alias("met"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count("r").alias("total"))
    return out.withColumn("percent", percent(F.col("met"), F.col("total")))


def page_builder_audit(g: KnowledgeGraph) -> DataFrame:
    """(kind, keys, n, with_diagnostics): sorted keys of each page-builder kind, and how many have an open diagnostic."""
    e = g.entities.where(F.col("kind_other").startswith("page_builder_")).select("id", F.col("kind_other").alias("kind"), "stable_key")
    bad = g.diagnostics.where("status = 'open'").select(F.explode("entities").alias("id")).distinct().withColumn("bad", F.lit(True))
    return e.join(bad, "id", "left").groupBy("kind").agg(F.array_sort(F.collect_list("stable_key")).alias("keys"), F.count("*").alias("n"), F.count_if("bad").alias("with_diagnostics"))
