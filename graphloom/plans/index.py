"""Indexing: from files to a published snapshot, in full or incrementally.

discover, classify, extract what changed, carry the rest forward, link, check, put, commit. Extraction is incremental; relations and
diagnostics follow from all entities and facts and are derived anew, which is equal to any narrower refresh.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import TABLES, KnowledgeGraph, conform
from graphloom.operators import check, link
from graphloom.operators.incremental import carry_forward, classify, merge_entities, nothing_changed, planned_scope, upsert
from graphloom.plans.registry import Registry
from graphloom.plans.staging import stage
from graphloom.sources.extract import extract
from graphloom.sources.files import file_state


def staged(g: KnowledgeGraph) -> KnowledgeGraph:
    """The snapshot with its tables written, so that each of many rules reads columns and not the plan behind them."""
    return KnowledgeGraph(**{t: stage(getattr(g, t), t) for t in TABLES})


@dataclass
class Run:
    snapshot: str
    reused: bool
    scope: str
    files: dict[str, int]
    phases: dict[str, int] = field(default_factory=dict)  # milliseconds


def derived(g: KnowledgeGraph, registry: Registry) -> KnowledgeGraph:
    """``g`` with relations of all linkers and, after them, diagnostics of all checkers beside the extractors' own."""
    rows = link.rule_rows(g, registry.linkers)
    relations = g.relations if rows is None else stage(link.finished(rows), "relations")
    g = g.with_tables(relations=relations)
    found = check.rule_rows(g, registry.checkers)
    if found is None:
        return g
    return g.with_tables(diagnostics=stage(upsert(g.diagnostics, check.finished(found)), "diagnostics"))


def union(a: KnowledgeGraph, b: KnowledgeGraph) -> KnowledgeGraph:
    """Carried-forward rows with new ones: entities merged field by field, other tables' last row of an id."""
    both = a.entities.withColumn("seq", F.lit(0)).unionByName(b.entities.withColumn("seq", F.lit(1)))
    return KnowledgeGraph(conform(merge_entities(both), "entities"), upsert(a.facts, b.facts), upsert(a.relations, b.relations), upsert(a.diagnostics, b.diagnostics), a.file_state.unionByName(b.file_state))


def index(store, files: DataFrame, registry: Registry | None = None, full: bool = False) -> Run:
    """Publish a snapshot of ``files`` and say what was done; without a change the latest snapshot stays."""
    registry = registry or Registry()
    phases: dict[str, int] = {}
    began = [time.monotonic()]

    def lap(name: str) -> None:
        now = time.monotonic()
        phases[name] = round(1000 * (now - began[0]))
        began[0] = now

    files = stage(files, "files")
    lap("discover")
    last = None if full else store.latest()
    old = store.read(last) if last else KnowledgeGraph.empty(files.sparkSession)
    states = stage(classify(old.file_state, files), "states")
    n = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    lap("classify")
    had = old.file_state.select("path")
    added = not states.where("state = 'changed'").join(had, "path", "left_anti").isEmpty()
    scope = planned_scope([dict(x.invalidation) for x in registry.extractors.values()] + [{}] * bool(registry.checkers), added, bool(n.get("removed")))
    if last and nothing_changed(states):
        return Run(last, True, "file_local", n, phases)
    snapshot = store.begin()
    changed = files.join(states.where("state = 'changed'").select("path"), "path", "left_semi")
    new = extract(changed, snapshot, list(registry.extractors.values()))
    lap("extract")
    moved = states.where("state <> 'unchanged'").select("path")
    kept = carry_forward(old, moved, snapshot)
    # What linkers and checkers made is made anew; extractors' own diagnostics are carried.
    checkers = set(registry.checkers)
    own = kept.diagnostics.where(~F.exists("evidence", lambda e: F.coalesce(e["extractor"].isin(*checkers), F.lit(False)))) if checkers else kept.diagnostics
    g = union(kept.with_tables(relations=kept.relations.limit(0), diagnostics=own), new)
    g = g.with_tables(**{t: stage(getattr(g, t), t) for t in ("entities", "facts", "diagnostics")}, file_state=conform(file_state(files, snapshot), "file_state"))
    lap("merge")
    g = derived(g, registry)
    lap("derive")
    try:
        store.put(snapshot, g)
        store.commit(snapshot)
    except Exception:
        store.abort(snapshot)
        raise
    lap("store")
    for p in registry.projectors.values():
        p.project(store.read(snapshot), snapshot)
    lap("project")
    return Run(snapshot, False, scope, n, phases)
