"""Incremental maintenance: what changed, what is carried forward, merged, invalidated, compared and kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.kinds import severity_rank
from graphloom.functions.text import previous_snapshot
from graphloom.model import KnowledgeGraph
from graphloom.operators.query import affected_diagnostics, owned_by, produced_by
from graphloom.plans.staging import stage

#: What a change asks to be computed anew, least first.
SCOPES = ("file_local", "dependency_closure", "global")
MOST_OBJECTS, MOST_BYTES = 1_000_000, 512 << 20


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of tracked files: changed (new, or another hash or hint), unchanged or removed."""
    a = old.select("path", "content_hash", "language_hint", F.lit(True).alias("had"))
    b = new.select("path", F.col("content_hash").alias("h2"), F.col("language_hint").alias("l2"), F.lit(True).alias("has"))
    same = F.col("content_hash").eqNullSafe(F.col("h2")) & F.col("language_hint").eqNullSafe(F.col("l2"))
    state = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull() | ~same, "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def carry_forward(old: KnowledgeGraph, paths: DataFrame, snapshot: str) -> KnowledgeGraph:
    """The old rows that no changed or removed path (path) owns, as of the new snapshot.

    A fact stays only if its subject and object do, a relation if both ends do, a diagnostic if every entity it names does.
    """
    new = F.lit(snapshot)
    e = owned_by(old.entities, paths, keep=False).withColumn("snapshot", new)
    alive = stage(e.select("id"), "alive")
    f = owned_by(old.facts, paths, keep=False).join(alive.withColumnRenamed("id", "subject"), "subject", "left_semi")
    has = f.where("object is not null").join(alive.withColumnRenamed("id", "object"), "object", "left_semi")
    f = f.where("object is null").unionByName(has.select(*f.columns))
    r = owned_by(old.relations, paths, keep=False).join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")
    d = owned_by(old.diagnostics, paths, keep=False)
    lost = d.select(F.col("id").alias("lost"), F.explode("entities").alias("entity")).join(alive.withColumnRenamed("id", "entity"), "entity", "left_anti").select("lost").distinct()
    d = d.join(lost, d["id"] == lost["lost"], "left_anti")
    stamp = lambda df, like: df.withColumn("snapshot", new).select(*like.columns)
    state = old.file_state.join(paths.select("path"), "path", "left_anti")
    return KnowledgeGraph(e.select(*old.entities.columns), stamp(f, old.facts), stamp(r, old.relations), stamp(d, old.diagnostics), stamp(state, old.file_state))


def upsert(*tables: DataFrame) -> DataFrame:
    """Rows by id; of an id in several tables the last table's row stays (within a table, one of the rows)."""
    names, rows = tables[0].columns, None
    for n, t in enumerate(tables):
        own = t.select(*names).withColumn("seq", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    last = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"), F.xxhash64(*names))))
    return last.where("turn = 1").select(*names)


def source_rank(path: Column) -> Column:
    """30 in contracts, 20 in sources, 10 elsewhere, 0 without a path: whose fields an entity of several rows takes."""
    part = F.split(path, "/")
    return F.when(path.isNull(), 0).when(F.arrays_overlap(part, F.array(F.lit("contracts"), F.lit("contract"))), 30).when(F.arrays_overlap(part, F.array(F.lit("src"))), 20).otherwise(10)


def merge_entities(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each id of rows in ``order``, field by field.

    Name, kind and place come from the row of highest source rank (the later of equals); language and title are the last that are
    not null, aliases the last that are not empty, the payload the last; ownership is all of theirs.
    """
    at = F.col(order)
    best = F.struct(source_rank(F.col("source.path")).alias("r"), at.alias("o"))
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, at)).alias(c)
    some = F.lit(True)
    return rows.groupBy("id").agg(
        F.max_by("snapshot", at).alias("snapshot"),
        *(F.max_by(c, best).alias(c) for c in ("stable_key", "kind", "kind_other", "name")),
        last("title", F.col("title").isNotNull()),
        F.max_by("source", best).alias("source"),
        last("language", F.col("language").isNotNull()),
        F.coalesce(F.max_by(F.when(F.size("aliases") > 0, F.col("aliases")), F.when(F.size("aliases") > 0, at)), F.array().cast("array<string>")).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ownership")))).alias("ownership"),
        last("payload", some),
    )


def planned_scope(declared: Iterable[dict[str, str]], added: bool, removed: bool) -> str:
    """The widest scope that any adapter declares for the change: added files count before removed ones, these before changed ones."""
    change = "add" if added else "remove" if removed else "change"
    return max((d.get(change, "global") for d in declared), key=SCOPES.index, default="file_local")


def without_derived(g: KnowledgeGraph, linkers: list[str], checkers: list[str]) -> KnowledgeGraph:
    """The snapshot without relations and diagnostics that known linkers and checkers have made: they are made anew."""
    r, d = produced_by(g.relations, linkers), produced_by(g.diagnostics, checkers)
    return g.with_tables(relations=g.relations.join(r.select("id"), "id", "left_anti").select(*g.relations.columns), diagnostics=g.diagnostics.join(d.select("id"), "id", "left_anti").select(*g.diagnostics.columns))


def nothing_changed(states: DataFrame) -> bool:
    return states.where("state <> 'unchanged'").isEmpty()


def size_guard(g: KnowledgeGraph, objects: int = MOST_OBJECTS, size: int = MOST_BYTES) -> DataFrame:
    """One row: objects and JSON bytes of a batch, and whether it is within the limits."""
    rows = None
    for name in ("entities", "facts", "relations", "diagnostics"):
        t = getattr(g, name)
        own = t.select(F.octet_length(F.to_json(F.struct(*t.columns))).alias("b"))
        rows = own if rows is None else rows.union(own)
    return rows.agg(F.count("*").alias("objects"), F.coalesce(F.sum("b"), F.lit(0).cast("long")).alias("bytes")).withColumn("within", (F.col("objects") <= objects) & (F.col("bytes") <= size))


# --- contracts: (class, stable_key, name, payload)


def contract(g: KnowledgeGraph) -> DataFrame:
    """(class, stable_key, name, payload) of the snapshot's endpoints, schemas and examples."""
    k = F.when(F.col("kind") == "api_endpoint", "endpoint").when(F.col("kind") == "api_schema", "schema").when(F.col("kind") == "api_example", "example")
    return g.entities.select(k.alias("class"), "stable_key", "name", "payload").where("class is not null")


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(class, stable_key, change): added, removed, or changed (another name or payload). Payloads have sorted keys."""
    a = old.select("class", "stable_key", F.col("name").alias("n1"), F.col("payload").alias("p1"), F.lit(True).alias("had"))
    b = new.select("class", "stable_key", F.col("name").alias("n2"), F.col("payload").alias("p2"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~(F.col("n1").eqNullSafe(F.col("n2")) & F.col("p1").eqNullSafe(F.col("p2"))), "changed")
    return a.join(b, ["class", "stable_key"], "full_outer").select("class", "stable_key", change.alias("change")).where("change is not null")


def _list(payload: str, field: str) -> Column:
    """A payload's array of objects or strings as JSON texts."""
    raw = F.get_json_object(payload, f"$.{field}")
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def endpoint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stable_key, change): what of an endpoint's contract a client can see: removed; method, path, security changed; request or
    response schemas taken away; a documented status taken away."""
    e = lambda df, p: df.where("class = 'endpoint'").select("stable_key", F.col("payload").alias(p))
    both = e(old, "a").join(e(new, "b"), "stable_key", "left")
    gone = F.col("b").isNull()
    differs = lambda f: ~F.get_json_object("a", f"$.{f}").eqNullSafe(F.get_json_object("b", f"$.{f}"))
    lost = lambda f: F.size(F.array_except(_list("a", f), _list("b", f))) > 0
    checks = [("removed", gone)] + [(f"{n}_changed", ~gone & differs(f)) for n, f in (("method", "method"), ("path", "path"), ("security", "security_requirements"))]
    checks += [(f"{n}_changed", ~gone & (lost(f) | (F.size(F.array_except(_list("b", f), _list("a", f))) > 0))) for n, f in (("request_schemas", "request_schemas"), ("response_schemas", "response_schemas"))]
    checks.append(("status_removed", ~gone & lost("responses")))
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks)), lambda x: x.isNotNull())
    return both.select("stable_key", F.explode(found).alias("change"))


def _properties(column: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(column, "$.schema.properties"), "map<string,string>"), F.create_map().cast("map<string,string>"))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stable_key, change, field) of schemas: removed, type changed, required field added or taken away, property removed or of another type."""
    e = lambda df, p: df.where("class = 'schema'").select("stable_key", F.col("payload").alias(p))
    both = e(old, "a").join(e(new, "b"), "stable_key", "left").withColumns({"pa": _properties("a"), "pb": _properties("b"), "ra": _list("a", "schema.required"), "rb": _list("b", "schema.required")})
    kind = lambda p: F.get_json_object(p, "$.schema.type")
    of = lambda m, k: F.get_json_object(F.try_element_at(F.col(m), k), "$.type")
    row = lambda change, fields: F.transform(fields, lambda f: F.struct(F.lit(change).alias("change"), f.alias("field")))
    none = F.array().cast("array<struct<change:string,field:string>>")
    one = lambda change: F.array(F.struct(F.lit(change).alias("change"), F.lit(None).cast("string").alias("field")))
    shared = F.array_intersect(F.map_keys("pa"), F.map_keys("pb"))
    live = F.concat(
        F.when(~kind("a").eqNullSafe(kind("b")), one("type_changed")).otherwise(none),
        row("required_added", F.array_except("rb", "ra")),
        row("required_removed", F.array_except("ra", "rb")),
        row("property_removed", F.array_except(F.map_keys("pa"), F.map_keys("pb"))),
        row("property_type_changed", F.filter(shared, lambda k: ~of("pa", k).eqNullSafe(of("pb", k)))),
    )
    return both.select("stable_key", F.explode(F.when(F.col("b").isNull(), one("removed")).otherwise(live)).alias("c")).select("stable_key", "c.change", "c.field")


def breaking_diagnostics(changes: DataFrame, snapshot: str) -> DataFrame:
    """(id, kind, severity, status, title, message, stable_key): a diagnostic for each breaking change."""
    what = F.concat_ws(" ", "change", F.col("field")) if "field" in changes.columns else F.col("change")
    return changes.select(
        F.concat(F.lit("diag_breaking_"), F.sha2(F.concat_ws("\0", F.lit(snapshot), "stable_key", what), 256).substr(1, 16)).alias("id"),
        F.lit("api_breaking_change_detected").alias("kind"),
        F.when(F.col("change") == "removed", "high").otherwise("medium").alias("severity"),
        F.lit("open").alias("status"),
        F.lit("breaking change of a contract").alias("title"),
        F.concat_ws(": ", "stable_key", what).alias("message"),
        "stable_key",
    )


def retention(snapshots: DataFrame, keep: int, latest: str | None = None) -> DataFrame:
    """(id, seq, kept): the snapshot that is pointed at stays and counts, then the newest until ``keep`` stay."""
    if keep < 1:
        raise ValueError("at least one snapshot is kept")
    first = F.col("id").eqNullSafe(F.lit(latest))
    rank = F.row_number().over(Window.orderBy(first.desc(), F.desc("seq"), "id"))
    return snapshots.select("id", "seq", (rank <= keep).alias("kept"))


def diff_retention(diffs: DataFrame, kept: DataFrame, keep: int) -> DataFrame:
    """(id, seq, kept) of diffs (id, seq, old, new): the newest ``keep`` of those whose two snapshots (id) are kept."""
    have = kept.select("id")
    alive = diffs.join(have.withColumnRenamed("id", "old"), "old", "left_semi").join(have.withColumnRenamed("id", "new"), "new", "left_semi")
    top = alive.select("id", (F.row_number().over(Window.orderBy(F.desc("seq"), "id")) <= keep).alias("ok"))
    return diffs.select("id", "seq").join(top, "id", "left").select("id", "seq", F.coalesce("ok", F.lit(False)).alias("kept"))


# --- documents


def docs_check(g: KnowledgeGraph, current: str, required: tuple[str, ...] = ("id", "status", "last_verified_snapshot"), statuses: tuple[str, ...] = ("draft", "verified", "stale"), prefix: str = "docs/", least: str = "medium") -> DataFrame:
    """(id, issue, detail) of editable pages: missing fields, unknown status, stale snapshot, and diagnostics of ``least`` severity."""
    pages = g.entities.where((F.col("kind") == "documentation_page") & F.col("source.path").startswith(prefix) & (F.coalesce(F.get_json_object("payload", "$.documentation_layer"), F.get_json_object("payload", "$.layer")) == "editable"))
    field = lambda f: F.coalesce(F.get_json_object("payload", f"$.{f}"), F.get_json_object("payload", f"$.frontmatter_fields.{f}"))
    missing = F.filter(F.array(*(F.when(field(f).isNull(), F.lit(f)) for f in required)), lambda x: x.isNotNull())
    a = pages.select("id", F.lit("missing_field").alias("issue"), F.explode(missing).alias("detail"))
    b = pages.where(field("status").isNotNull() & ~field("status").isin(*statuses)).select("id", F.lit("status"), field("status"))
    c = pages.where(~field("last_verified_snapshot").isin(current)).select("id", F.lit("stale_snapshot"), field("last_verified_snapshot"))
    limit = {"critical": 0, "high": 1, "medium": 2, "low": 3}[least]
    d = g.diagnostics.where((F.col("status") == "open") & (severity_rank() <= limit)).select(F.explode("entities").alias("id"), F.lit("diagnostic").alias("issue"), F.col("id").alias("detail"))
    return a.union(b).union(c).union(d.join(pages.select("id"), "id", "left_semi").select("id", "issue", "detail"))


def docs_drift(g: KnowledgeGraph, current: str) -> DataFrame:
    """(id, verified): pages last verified neither at the current snapshot nor at the one before."""
    seen = F.coalesce(F.get_json_object("payload", "$.last_verified_snapshot"), F.get_json_object("payload", "$.frontmatter_fields.last_verified_snapshot"))
    before = previous_snapshot(F.lit(current))
    return g.entities.where("kind = 'documentation_page'").select("id", seen.alias("verified")).where((F.col("verified") != current) & ~F.col("verified").eqNullSafe(before))


def affected_report(g: KnowledgeGraph, states: DataFrame, current: str, artifacts: DataFrame | None = None) -> DataFrame:
    """(part, id) of a change: changed and removed files, open diagnostics they touch, drifted pages, and artifacts (id, snapshot) of an older snapshot."""
    moved = states.where("state <> 'unchanged'")
    out = moved.select(F.col("state").alias("part"), F.col("path").alias("id"))
    out = out.union(affected_diagnostics(g, moved).select(F.lit("diagnostic"), "id")).union(docs_drift(g, current).select(F.lit("drift"), "id"))
    if artifacts is not None:
        out = out.union(artifacts.where(F.col("snapshot") != current).select(F.lit("stale_artifact"), "id"))
    return out
