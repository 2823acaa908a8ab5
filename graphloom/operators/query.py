"""Point queries: conjunctive filters over the canonical tables, explanation, registry and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.kinds import display_kind, severity_rank
from graphloom.model import KnowledgeGraph
from graphloom.plans.staging import stage

SCOPES = {
    "api": (
        "openapi_mismatch dead_endpoint api_endpoint_missing_in_openapi api_endpoint_documented_but_not_implemented api_endpoint_implemented_but_not_documented "
        "api_method_mismatch api_path_mismatch api_request_schema_mismatch api_response_schema_mismatch api_status_code_undocumented api_auth_requirement_mismatch "
        "api_permission_mismatch api_example_invalid api_error_model_mismatch api_breaking_change_detected"
    ).split(),
    "docs": "empty_documentation_page documentation_page_missing_title missing_documentation stale_documentation documentation_reference_unresolved duplicate_documentation_id orphan_doc translation_outdated".split(),
    "env": ["missing_env_var", "missing_documentation"],
    "scripts": ["missing_documentation"],
    "deployment": ["missing_documentation"],
    "runbooks": ["missing_documentation", "stale_documentation"],
}
#: Scopes of open kinds, by the family that an adapter's kinds begin with.
FAMILIES = ("ffa", "fba", "page_builder")


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    return df if limit is None else df.orderBy(*(order or ("id",))).limit(limit)


def query_entities(g: KnowledgeGraph, stable_key: str | None = None, kind: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities that meet every filter given; ``text`` is a case-sensitive part of name, title or an alias."""
    e, w = g.entities, []
    if stable_key is not None:
        w.append(F.col("stable_key") == stable_key)
    if kind is not None:
        w.append(display_kind() == kind)
    if text is not None:
        part = lambda c: F.coalesce(F.contains(c, F.lit(text)), F.lit(False))
        w.append(part(F.col("name")) | part(F.col("title")) | F.coalesce(F.exists("aliases", part), F.lit(False)))
    return _top(_all(e, w), limit)


def query_relations(g: KnowledgeGraph, src: str | None = None, dst: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    w = [c for c in (src is not None and F.col("src") == src, dst is not None and F.col("dst") == dst, kind is not None and display_kind() == kind) if c is not False]
    return _top(_all(g.relations, w), limit)


def query_diagnostics(g: KnowledgeGraph, severity: str | None = None, status: str | None = None, entity: str | None = None, limit: int | None = None) -> DataFrame:
    """Severity and status compare without case; ``entity`` must be among the diagnostic's entities."""
    w = []
    if severity is not None:
        w.append(F.lower("severity") == severity.lower())
    if status is not None:
        w.append(F.lower("status") == status.lower())
    if entity is not None:
        w.append(F.array_contains("entities", entity))
    return _top(_all(g.diagnostics, w), limit)


def query_facts(g: KnowledgeGraph, subject: str | None = None, object: str | None = None, kind: str | None = None, extractor: str | None = None, limit: int | None = None) -> DataFrame:  # noqa: A002
    """``object`` drops facts without one; open kinds are all 'other'; kinds compare without case."""
    w = []
    if subject is not None:
        w.append(F.col("subject") == subject)
    if object is not None:
        w.append(F.col("object") == object)
    if kind is not None:
        w.append(F.lower(display_kind("query")) == kind.lower())
    if extractor is not None:
        w.append(F.col("extractor") == extractor)
    return _top(_all(g.facts, w), limit)


def resolve_stable_key(g: KnowledgeGraph, stable_key: str) -> str | None:
    """The one entity id of a key, none, or an error if there are several."""
    found = g.entities.where(F.col("stable_key") == stable_key).select("id").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"stable key {stable_key!r} is of several entities")
    return found[0]["id"] if found else None


def resolve_target(g: KnowledgeGraph, target: str) -> DataFrame:
    """Entities of a stable key, else of a path; an error if there are none."""
    exact = g.entities.where(F.col("stable_key") == target)
    if not exact.isEmpty():
        return exact
    by_path = g.entities.where((F.col("source.path") == target) | F.exists("ownership", lambda o: o["source_file"] == target))
    if by_path.isEmpty():
        raise LookupError(f"no entity of key or path {target!r}")
    return by_path


def scope_filter(g: KnowledgeGraph, scope: str, policy: dict[str, bool] | None = None, family_prefix: str = "") -> DataFrame:
    """Open diagnostics of a scope, worst first.

    Scopes that share kinds are told apart by the payload's ``scope``. ``policy`` may switch API kinds off:
    missing_docs, documented_only, openapi_mismatch, undocumented_status_code (all on by default).
    """
    d = g.diagnostics.where(F.col("status") == "open")
    own = F.get_json_object("payload", "$.scope")
    if scope in FAMILIES:
        d = d.where(F.coalesce(F.col("kind_other"), F.lit("")).startswith(f"{family_prefix}{scope}_"))
    else:
        d = d.where(F.col("kind_other").isNull() & F.col("kind").isin(*SCOPES[scope]))
    if scope in ("scripts", "deployment", "runbooks"):
        d = d.where(own == scope)
    elif scope == "env":
        d = d.where((F.col("kind") != "missing_documentation") | (own == "env"))
    elif scope == "docs":
        d = d.where(own.isNull())
    elif scope == "api":
        d = api_policy(d, policy or {})
    return d.orderBy(severity_rank(), "id")


def api_policy(diagnostics: DataFrame, policy: dict[str, bool]) -> DataFrame:
    off = {
        "missing_docs": ("api_endpoint_implemented_but_not_documented",),
        "documented_only": ("api_endpoint_documented_but_not_implemented",),
        "openapi_mismatch": ("api_request_schema_mismatch", "api_response_schema_mismatch", "api_example_invalid"),
        "undocumented_status_code": ("api_status_code_undocumented",),
    }
    dropped = [k for name, kinds in off.items() if not policy.get(name, True) for k in kinds]
    return diagnostics.where(~F.col("kind").isin(*dropped)) if dropped else diagnostics


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return diagnostics.agg(F.count("*").alias("total"), n("critical"), n("high"), n("medium"), n("low"))


def owned_by(df: DataFrame, paths: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of any canonical table whose ownership names one of ``paths`` (path); or, with ``keep`` off, the others.

    The owners among ``paths`` are told first, each once: a path may own most of a table, and its rows must not meet in one task.
    """
    owned = df.select("id", F.explode("ownership.source_file").alias("path"))
    hit = stage(owned.select("path").distinct().join(paths.select("path").distinct(), "path", "left_semi"), "owners")
    if hit.isEmpty():
        return df.limit(0) if keep else df
    owners = owned.join(hit, "path", "left_semi").select("id").distinct()
    return df.join(owners, "id", "left_semi" if keep else "left_anti")


def affected_entities(g: KnowledgeGraph, paths: DataFrame) -> DataFrame:
    """Entities that are owned by, or lie in, one of ``paths``."""
    places = g.entities.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("ownership.source_file", F.array().cast("array<string>")), F.array("source.path")))).alias("path"))
    return g.entities.join(places.join(paths.select("path"), "path", "left_semi").select("id").distinct(), "id", "left_semi")


def affected_diagnostics(g: KnowledgeGraph, paths: DataFrame) -> DataFrame:
    """Open diagnostics that touch an affected entity or whose ownership or evidence names one of ``paths``."""
    d = g.diagnostics.where("status = 'open'")
    hit = affected_entities(g, paths).select("id")
    by_entity = d.select("id", F.explode("entities").alias("e")).join(hit.withColumnRenamed("id", "e"), "e", "left_semi").select("id")
    places = d.select("id", F.explode(F.concat(F.coalesce("ownership.source_file", F.array().cast("array<string>")), F.coalesce("evidence.source_file", F.array().cast("array<string>")))).alias("path"))
    by_path = places.join(paths.select("path"), "path", "left_semi").select("id")
    return d.join(by_entity.union(by_path).distinct(), "id", "left_semi")


def editable_pages(g: KnowledgeGraph, prefix: str) -> DataFrame:
    return g.entities.where((F.col("kind") == "documentation_page") & (F.get_json_object("payload", "$.layer") == "editable") & F.col("source.path").startswith(prefix))


def produced_by(df: DataFrame, adapters: list[str]) -> DataFrame:
    """Rows with evidence of one of these adapters."""
    return df.where(F.exists("evidence", lambda e: e["extractor"].isin(*adapters)))


def explain(g: KnowledgeGraph, stable_key: str) -> dict[str, DataFrame]:
    """An entity's row, facts as subject or object, relations with their neighbours (null if unknown) and diagnostics."""
    own = g.entities.where(F.col("stable_key") == stable_key)
    key = own.select(F.col("id").alias("own_id"))
    f = g.facts.join(F.broadcast(key), (F.col("subject") == F.col("own_id")) | F.col("object").eqNullSafe(F.col("own_id")), "left_semi")
    names = g.entities.select(F.col("id").alias("neighbour"), F.col("stable_key").alias("neighbour_key"), F.col("name").alias("neighbour_name"))
    kind = display_kind()
    out = g.relations.join(F.broadcast(key), F.col("src") == F.col("own_id"), "left_semi").select("id", kind.alias("kind"), F.lit("out").alias("direction"), F.col("dst").alias("neighbour"))
    back = g.relations.join(F.broadcast(key), F.col("dst") == F.col("own_id"), "left_semi").select("id", kind.alias("kind"), F.lit("in").alias("direction"), F.col("src").alias("neighbour"))
    rel = out.unionByName(back).join(names, "neighbour", "left")
    d = g.diagnostics.select("*", F.explode("entities").alias("e")).join(F.broadcast(key), F.col("e") == F.col("own_id"), "left_semi").drop("e").dropDuplicates(["id"])
    return {"entity": own, "facts": f, "relations": rel, "diagnostics": d}


def registry(g: KnowledgeGraph, endpoint_kind: str = "api_endpoint") -> DataFrame:
    """For each endpoint: its fields, first implementation by relation id, and the sorted set of documents."""
    e = g.entities.where(display_kind() == endpoint_kind).select("id", "stable_key", "name", *(F.get_json_object("payload", f"$.{f}").alias(f) for f in ("method", "path", "operation_id", "summary")))
    names = g.entities.select(F.col("id").alias("other"), F.col("stable_key").alias("other_key"))
    impl = g.relations.where("kind = 'implemented_by'").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("id").alias("rel")).join(names, "other").groupBy("id").agg(F.min_by("other_key", "rel").alias("handler"))
    docs = g.relations.where("kind in ('documents', 'documents_api', 'documents_operation')").select(F.col("dst").alias("id"), F.col("src").alias("other")).join(names, "other").groupBy("id").agg(F.array_sort(F.collect_set("other_key")).alias("documents"))
    return e.join(impl, "id", "left").join(docs, "id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>"))).orderBy("stable_key")


def validate_metadata(g: KnowledgeGraph) -> DataFrame:
    """(table, id, issue) of rows without ownership or evidence; a run must not publish any."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    out = g.entities.where(none("ownership")).select(F.lit("entities").alias("table"), "id", F.lit("no ownership").alias("issue"))
    for name in ("facts", "relations", "diagnostics"):
        t = getattr(g, name)
        for column in ("evidence", "ownership"):
            out = out.union(t.where(none(column)).select(F.lit(name), "id", F.lit(f"no {column}")))
    return out
