"""Linkers: rules that derive relations from entities and facts.

A rule is a pair of keyed tables, (src, src_key, src_path, key) and (dst, dst_key, dst_path, key), joined on ``key``; several keys
by priority are several rows with a ``prio``, of which the least that meets anything counts. All are
equi-joins, so Catalyst broadcasts or shuffles by size and can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a64, named_type, normalized, parent_name, resolved_path, static_segment
from graphloom.model import EVIDENCE, KnowledgeGraph, conform
from graphloom.plans.staging import stage

JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
NONE = "array<string>"


def field(name: str, column: str = "payload") -> Column:
    return F.get_json_object(column, f"$.{name}")


def strings(name: str, column: str = "payload") -> Column:
    """A payload's array of strings; empty if there is none."""
    return F.coalesce(F.from_json(field(name, column), NONE), F.array().cast(NONE))


def keyed(entities: DataFrame, end: str, key: Column, *more: Column) -> DataFrame:
    """(end, end_key, end_path, key, ...) of entities whose key is not null."""
    return entities.select(F.col("id").alias(end), F.col("stable_key").alias(f"{end}_key"), F.col("source.path").alias(f"{end}_path"), key.alias("key"), *more).where("key is not null")


def emit(pairs: DataFrame, kind: str | Column, confidence: float, status: str = "verified", linker: str = "", open_kind: bool = False, snapshot: str = "") -> DataFrame:
    """Relations of (src, src_key, src_path, dst, dst_key, dst_path), with the text that ``finished`` makes an id of."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    path = F.col("src_path")
    one = F.struct(path.alias("source_file"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(linker).alias("extractor"), F.lit(None).cast("string").alias("commit_hash"), F.lit(confidence).cast("float").alias("confidence"), F.lit("verified" if status == "verified" else "inferred").alias("status"))
    owners = F.transform(F.array_compact(F.array_distinct(F.array("src_path", "dst_path"))), lambda p: F.struct(p.alias("source_file")))
    out = pairs.select(
        F.lit(snapshot).alias("snapshot"),
        F.concat_ws("\0", k, "src_key", "dst_key").alias("id_text"),
        (F.lit("other") if open_kind else k).alias("kind"),
        (k if open_kind else F.lit(None).cast("string")).alias("kind_other"),
        "src",
        "dst",
        F.lit(status).alias("status"),
        F.lit(confidence).cast("float").alias("confidence"),
        F.array(one).cast(EVIDENCE).alias("evidence"),
        owners.alias("ownership"),
        F.lit("{}").alias("payload"),
    )
    return out


def finished(rows: DataFrame) -> DataFrame:
    """Relation rows with ids, each id once. Ids are hashed here, after the rules' union, so that the plan holds one such expression."""
    return conform(rows.withColumn("id", F.concat(F.lit("rel_"), fnv1a64(F.col("id_text")))), "relations").dropDuplicates(["id"])


def equi(left: DataFrame, right: DataFrame, selfs: bool = False) -> DataFrame:
    out = left.join(right, "key").drop("key")
    return out if selfs else out.where("src <> dst")


def first_match(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Of each ``by`` the pair of least ``prio``, then destination key."""
    met = left.join(right, "key").where("src <> dst")
    best = met.groupBy(*by).agg(F.min(F.struct("prio", "dst_key", "dst", "dst_path", "src_key", "src_path")).alias("m"))
    names = [c for c in ("src", "src_key", "src_path", "dst", "dst_key", "dst_path") if c not in by]
    return best.select(*by, *(F.col(f"m.{c}").alias(c) for c in names if c in ("src_key", "src_path", "dst", "dst_key", "dst_path")))


def unique_keys(right: DataFrame) -> DataFrame:
    """Rows whose key no other row has."""
    once = right.groupBy("key").agg(F.count("*").alias("n")).where("n = 1").select("key")
    return right.join(once, "key", "left_semi")


def of_kind(g: KnowledgeGraph, *kinds: str) -> DataFrame:
    return g.entities.where(F.coalesce("kind_other", "kind").isin(*kinds))


# --- Rust


def rust(g: KnowledgeGraph) -> DataFrame:
    return g.entities.where(F.col("stable_key").startswith("symbol://rust:")).withColumn("qn", field("qualified_name"))


def rust_contains(g: KnowledgeGraph) -> DataFrame:
    e = rust(g)
    return emit(equi(keyed(e, "src", F.col("qn")), keyed(e, "dst", parent_name(F.col("qn")))), "contains", 1.0, linker="linker-rust")


def candidates(scope: Column, imports: Column, path: Column) -> Column:
    """Qualified names that a Rust path in a module may mean, by priority: in the module itself, through each import (by
    its last name, or a glob), then from crate, self, super or as it stands."""
    head, rest = F.split_part(path, F.lit("::"), F.lit(1)), F.regexp_replace(path, r"^[^:]+(::)?", "")
    joined = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("::"), b))
    crate = F.split_part(scope, F.lit("::"), F.lit(1))
    up = F.coalesce(parent_name(scope), scope)
    absolute = lambda p: (
        F.when(p.startswith("crate::"), F.concat(crate, F.lit("::"), F.substring(p, F.lit(8), F.length(p))))
        .when(p.startswith("self::"), F.concat(scope, F.lit("::"), F.substring(p, F.lit(7), F.length(p))))
        .when(p.startswith("super::"), F.concat(up, F.lit("::"), F.substring(p, F.lit(8), F.length(p))))
        .otherwise(p)
    )
    through = F.transform(
        imports,
        lambda i: F.when(i.endswith("::*"), F.concat(absolute(F.regexp_replace(i, r"::\*$", "")), F.lit("::"), path)).when(F.regexp_extract(i, r"([^:]+)$", 1) == head, joined(absolute(i), rest)),
    )
    every = F.concat(F.array(F.concat(scope, F.lit("::"), path)), through, F.array(absolute(path)))
    return F.filter(F.transform(every, lambda c, n: F.struct(n.alias("prio"), c.alias("key"))), lambda s: s["key"].isNotNull())


def rust_imports(g: KnowledgeGraph) -> DataFrame:
    e = rust(g)
    uses = keyed(e.where("kind = 'module'"), "src", F.col("qn"), F.explode(strings("imports")).alias("use"))
    none = F.array().cast(NONE)
    asked = uses.withColumn("c", F.explode(candidates(F.col("key"), none, F.regexp_replace("use", r"::\*$", "")))).select("src", "src_key", "src_path", "use", "c.prio", "c.key")
    found = first_match(asked, keyed(e, "dst", F.col("qn")), ["src", "use"])
    return emit(found.drop("use").dropDuplicates(["src", "dst"]), "imports", 1.0, linker="linker-rust")


def rust_calls(g: KnowledgeGraph) -> DataFrame:
    e = rust(g)
    modules = e.where("kind = 'module'").select(F.col("qn").alias("scope"), strings("imports").alias("imports"))
    callers = keyed(e.where("kind in ('function', 'test_case')"), "src", F.col("qn"), F.explode(strings("calls")).alias("call")).withColumn("scope", parent_name(F.col("key")))
    asked = callers.join(modules, "scope", "left").withColumn("c", F.explode(candidates(F.coalesce("scope", F.lit("")), F.coalesce("imports", F.array().cast(NONE)), F.col("call")))).select("src", "src_key", "src_path", "call", "c.prio", "c.key")
    found = first_match(asked, keyed(e.where("kind in ('function', 'test_case')"), "dst", F.col("qn")), ["src", "call"])
    return emit(found.drop("call").dropDuplicates(["src", "dst"]), "calls", 0.8, "inferred", "linker-rust")


def tested_by(g: KnowledgeGraph, calls: DataFrame) -> DataFrame:
    """A call from a test to a function, seen from the function."""
    e = g.entities.select("id", "stable_key", "source.path", "kind")
    test, function = e.where("kind = 'test_case'").drop("kind"), e.where("kind = 'function'").drop("kind")
    r = calls.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return emit(r.join(test.toDF("dst", "dst_key", "dst_path"), "dst").join(function.toDF("src", "src_key", "src_path"), "src"), "tested_by", 0.9, "inferred", "linker-rust")


# --- APIs


def endpoint_examples(g: KnowledgeGraph) -> DataFrame:
    return emit(equi(keyed(of_kind(g, "api_example"), "src", field("endpoint")), keyed(of_kind(g, "api_endpoint"), "dst", F.col("stable_key"))), "example_for", 1.0, linker="linker-api")


def endpoint_schemas(g: KnowledgeGraph, side: str) -> DataFrame:
    """Requests (``side`` request) or responses of an endpoint to the schemas of its own file that they refer to."""
    uses = keyed(of_kind(g, "api_endpoint"), "src", F.col("source.path"), F.explode(strings(f"{side}_schemas")).alias("use"))
    uses = uses.withColumn("key", F.concat_ws("\0", "key", F.coalesce(F.get_json_object("use", "$.reference"), F.col("use")))).drop("use").distinct()
    schemas = keyed(of_kind(g, "api_schema"), "dst", F.concat_ws("\0", F.col("source.path"), F.concat(F.lit("#/components/schemas/"), F.col("name"))))
    return emit(equi(uses, schemas).distinct(), f"schema_for_{side}", 1.0, linker="linker-api")


def endpoint_implementations(g: KnowledgeGraph) -> DataFrame:
    op = F.coalesce(field("operation_id"), field("operation_name"))
    named = lambda c: F.nullif(normalized(c), F.lit(""))
    return emit(equi(keyed(of_kind(g, "api_endpoint"), "src", named(op)), keyed(g.entities.where("kind = 'function'"), "dst", named(F.col("name")))), "implemented_by", 0.7, "inferred", "linker-api")


#: Most words that each task looks up in a text; beyond, texts and words meet in a join. Up to FEW each word is searched by itself.
MOST_WORDS, FEW = 200_000, 64


def held_words(text: Column, words: list[str]) -> Column:
    """Those of ``words`` (each of three letters or more) that a text contains. A text is read once, for each length of the words that
    begin with the three letters at hand."""
    known, lengths = frozenset(words), {}
    for w in known:
        lengths.setdefault(w[:3], set()).add(len(w))

    def of(t: str) -> list[str]:
        if len(known) <= FEW:
            return [w for w in known if w in t]
        near = ((i, n) for i in range(len(t) - 2) for n in lengths.get(t[i : i + 3], ()))
        return list({w for i, n in near if (w := t[i : i + n]) in known})

    return F.arrow_udf(lambda a: pa.array([of(t) if t else [] for t in a.to_pylist()], pa.list_(pa.string())), NONE)(text)


def trigrams(text: Column) -> Column:
    """The distinct runs of three letters of a text, in time of its length."""
    return F.arrow_udf(lambda a: pa.array([list({t[i : i + 3] for i in range(len(t) - 2)}) if t else [] for t in a.to_pylist()], pa.list_(pa.string())), NONE)(text)


def documents_endpoints(g: KnowledgeGraph, most: int = MOST_WORDS) -> DataFrame:
    """Pages and sections whose letters and digits contain an endpoint's operation id, else its last static path segment, else its first tag.

    Candidates have three letters or more. Up to ``most`` distinct ones are looked up in each text where it lies. Of more, a text's
    trigrams meet the first trigram of a candidate, then the whole candidate is verified: an equi-join, not every text with every endpoint.
    """
    names = F.array(normalized(field("operation_id")), normalized(static_segment(field("path"))), normalized(F.get(strings("tags"), F.lit(0))))
    many = F.filter(F.transform(names, lambda c, n: F.struct(n.alias("prio"), c.alias("word"))), lambda s: F.length(s["word"]) >= 3)
    ends = of_kind(g, "api_endpoint").select(F.col("id").alias("dst"), F.col("stable_key").alias("dst_key"), F.col("source.path").alias("dst_path"), F.explode(many).alias("c")).select("*", "c.prio", "c.word").drop("c")
    text = normalized(F.concat_ws(" ", "name", "title", "aliases", field("text")))
    docs = of_kind(g, "documentation_page", "documentation_section").select(F.col("id").alias("src"), F.col("stable_key").alias("src_key"), F.col("source.path").alias("src_path"), "kind", text.alias("text")).where(F.length("text") >= 3)
    words = [r["word"] for r in ends.select("word").distinct().limit(most + 1).collect()]
    if not words:
        docs = docs.limit(0)
    if len(words) <= most:
        found = docs.select("src", "src_key", "src_path", "kind", F.explode(held_words(F.col("text"), words)).alias("word")).join(ends, "word")
    else:
        first = ends.withColumn("key", F.substring("word", 1, 3))
        found = docs.select("src", F.explode(trigrams(F.col("text"))).alias("key")).join(first, "key").drop("key").join(docs, "src").where(F.contains("text", F.col("word")))
    pairs = found.select("src", "src_key", "src_path", "kind", "dst", "dst_key", "dst_path").distinct()
    section = pairs.where("kind = 'documentation_section'")
    return emit(section, "documents_operation", 0.5, "inferred", "linker-api").unionByName(emit(pairs.where("kind = 'documentation_page'"), "documents_api", 0.5, "inferred", "linker-api"))


# --- GraphQL


def _graphql(g: KnowledgeGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    graphql = field("protocol") == "graphql"
    return of_kind(g, "api_endpoint").where(graphql), of_kind(g, "api_schema").where(graphql), of_kind(g, "graphql_fragment")


def fragment_uses(g: KnowledgeGraph) -> DataFrame:
    """Operations to the fragments that they spread; of several fragments of a name the first by id."""
    ops, _, fragments = _graphql(g)
    first = keyed(fragments, "dst", F.col("name")).groupBy("key").agg(F.min(F.struct("dst", "dst_key", "dst_path")).alias("m")).select("key", "m.*")
    return emit(equi(keyed(ops, "src", F.explode(F.array_distinct(strings("fragment_spreads")))), first), "graphql_uses_fragment", 1.0, linker="linker-api", open_kind=True)


def _last_schema(schemas: DataFrame) -> DataFrame:
    """Of several schemas of a name the last by id."""
    return keyed(schemas, "dst", F.col("name")).groupBy("key").agg(F.max(F.struct("dst", "dst_key", "dst_path")).alias("m")).select("key", "m.*")


def inline_conditions(g: KnowledgeGraph) -> DataFrame:
    ops, schemas, _ = _graphql(g)
    return emit(equi(keyed(ops, "src", F.explode(F.array_distinct(strings("inline_type_conditions")))), _last_schema(schemas)), "graphql_inline_type_condition", 1.0, linker="linker-api", open_kind=True)


def returned_types(g: KnowledgeGraph) -> DataFrame:
    """Operations to the types of the root members that they select."""
    ops, schemas, _ = _graphql(g)
    roots = ops.select("id", "stable_key", F.col("source.path").alias("path"), F.initcap(field("operation_type")).alias("root"), F.explode(F.array_distinct(strings("selection_roots"))).alias("member"))
    members = schemas.select(F.col("name").alias("root"), F.explode(F.from_json(field("member_types"), "array<struct<name:string,type:string>>")).alias("m")).select("root", F.col("m.name").alias("member"), named_type(F.col("m.type")).alias("key"))
    src = roots.join(members, ["root", "member"]).select(F.col("id").alias("src"), F.col("stable_key").alias("src_key"), F.col("path").alias("src_path"), "key").distinct()
    return emit(equi(src, _last_schema(schemas)), "graphql_operation_queries_type", 1.0, linker="linker-api", open_kind=True)


def fragment_conditions(g: KnowledgeGraph) -> DataFrame:
    _, schemas, fragments = _graphql(g)
    return emit(equi(keyed(fragments, "src", field("type_condition")), _last_schema(schemas)), "graphql_fragment_type_condition", 1.0, linker="linker-api", open_kind=True)


def fragment_spreads(g: KnowledgeGraph) -> DataFrame:
    _, _, fragments = _graphql(g)
    first = keyed(fragments, "dst", F.col("name")).groupBy("key").agg(F.min(F.struct("dst", "dst_key", "dst_path")).alias("m")).select("key", "m.*")
    return emit(equi(keyed(fragments, "src", F.explode(F.array_distinct(strings("fragment_spreads")))), first), "graphql_fragment_spread_resolution", 1.0, linker="linker-api", open_kind=True)


# --- documents


def document_containment(g: KnowledgeGraph) -> DataFrame:
    """File to page, page to sections, page to runbook, runbook to steps: all of one file."""
    path = F.col("source.path")
    file = keyed(of_kind(g, "file"), "src", path).groupBy("key").agg(F.min(F.struct("src", "src_key", "src_path")).alias("m")).select("key", "m.*")
    side = lambda kind, end: keyed(of_kind(g, kind), end, path)
    pairs = [(file, side("documentation_page", "dst")), (side("documentation_page", "src"), side("documentation_section", "dst")), (side("documentation_page", "src"), side("runbook", "dst")), (side("runbook", "src"), side("operation_step", "dst"))]
    out = None
    for a, b in pairs:
        rows = emit(equi(a, b), "contains", 1.0, linker="linker-markdown")
        out = rows if out is None else out.unionByName(rows)
    return out


def declared_references(g: KnowledgeGraph) -> DataFrame:
    """Pages to the entities and concepts that they declare by a key which only one entity has."""
    declared = F.explode(F.array_distinct(F.concat(strings("entities"), strings("concepts"))))
    return emit(equi(keyed(of_kind(g, "documentation_page"), "src", declared), unique_keys(keyed(g.entities, "dst", F.col("stable_key")))), "documents", 1.0, linker="linker-markdown")


# --- JavaScript


def js_imports(g: KnowledgeGraph) -> DataFrame:
    """Modules to the modules that a relative import means: the path itself, else with each ending in order."""
    m = g.entities.where(F.col("stable_key").startswith("module://js-ts:"))
    folder = F.regexp_replace("src_path", r"/?[^/]*$", "")
    uses = keyed(m, "src", F.col("source.path"), F.explode(F.array_distinct(strings("imports"))).alias("use")).where(F.col("use").startswith("."))
    base = resolved_path(folder, F.col("use"))
    many = F.posexplode(F.transform(F.array(*map(F.lit, JS_ENDINGS)), lambda x: F.concat(F.col("base"), x)))
    asked = uses.withColumn("base", base).select("src", "src_key", "src_path", "use", many.alias("prio", "key"))
    found = first_match(asked, keyed(m, "dst", F.col("source.path")), ["src", "use"])
    return emit(found.drop("use").dropDuplicates(["src", "dst"]), "imports", 1.0, linker="linker-js-ts")


# --- surfaces, contracts, page builder


def referenced(g: KnowledgeGraph, src_prefix: str, key: Column, kind: str, linker: str, open_kind: bool = False) -> DataFrame:
    """Entities of a key prefix to the entity of the stable key(s) that ``key`` tells."""
    src = g.entities.where(F.col("stable_key").startswith(src_prefix))
    return emit(equi(keyed(src, "src", key), keyed(g.entities, "dst", F.col("stable_key"))), kind, 1.0, linker=linker, open_kind=open_kind)


def _up(scheme: str, parts: int) -> Column:
    """The key of another scheme made of the first parts of one's own."""
    own = F.split(F.regexp_replace("stable_key", r"^[a-z_]+://", ""), "/")
    return F.concat(F.lit(f"{scheme}://"), F.array_join(F.slice(own, 1, parts), "/"))


def reversed_ends(r: DataFrame, g: KnowledgeGraph, kind: str, linker: str, open_kind: bool = False) -> DataFrame:
    e = g.entities.select("id", "stable_key", "source.path")
    turned = r.select(F.col("src").alias("dst"), F.col("dst").alias("src")).join(e.toDF("src", "src_key", "src_path"), "src").join(e.toDF("dst", "dst_key", "dst_path"), "dst")
    return emit(turned, kind, 1.0, linker=linker, open_kind=open_kind)


def surface_links(g: KnowledgeGraph) -> DataFrame:
    """Surface contains layer; layer is implemented by the file that its facts are evidence of."""
    up = reversed_ends(referenced(g, "ffa_layer://", _up("ffa_surface", 2), "contains", "adapter-ffa"), g, "contains", "adapter-ffa")
    files = g.facts.where("kind_other = 'ffa_layer_marker'").select(F.col("subject").alias("src"), F.explode("evidence.source_file").alias("path")).distinct()
    lay = g.entities.where(F.col("stable_key").startswith("ffa_layer://")).select(F.col("id").alias("src"), F.col("stable_key").alias("src_key"), F.col("source.path").alias("src_path"))
    src = lay.join(files, "src").select("src", "src_key", "src_path", F.concat(F.lit("file://"), "path").alias("key"))
    return up.unionByName(emit(equi(src, keyed(of_kind(g, "file"), "dst", F.col("stable_key"))), "implemented_by", 1.0, linker="adapter-ffa"))


def contract_links(g: KnowledgeGraph) -> DataFrame:
    """Module contains contract, contract contains port, port contains operation; dependency to its provider, consumer to dependency."""
    rows = [
        reversed_ends(referenced(g, "fba_contract://", _up("fba_module", 1), "contains", "adapter-fba"), g, "contains", "adapter-fba"),
        reversed_ends(referenced(g, "fba_port://", _up("fba_module", 1), "contains", "adapter-fba"), g, "contains", "adapter-fba"),
        reversed_ends(referenced(g, "fba_operation://", _up("fba_port", 2), "contains", "adapter-fba"), g, "contains", "adapter-fba"),
        reversed_ends(referenced(g, "fba_dependency://", _up("fba_module", 1), "requires_dependency", "adapter-fba", True), g, "requires_dependency", "adapter-fba", True),
        referenced(g, "fba_dependency://", F.concat(F.lit("fba_module://"), F.split(F.regexp_replace("stable_key", r"^[a-z_]+://", ""), "/")[1]), "consumer_requires_provider", "adapter-fba", True),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def page_builder_links(g: KnowledgeGraph) -> DataFrame:
    """Consumer to provider, profiles, waves and hosts that its payload lists by key."""
    out = None
    for name, kind in (("provider", "consumes_provider"), ("profiles", "uses_profile"), ("waves", "has_wave"), ("hosts", "hosted_by")):
        key = F.explode(F.array_distinct(F.concat(strings(name), F.array_compact(F.array(F.when(~F.coalesce(field(name), F.lit("[")).startswith("["), field(name)))))))
        rows = referenced(g, "page_builder_consumer://", key, f"page_builder_{kind}", "adapter-page-builder", True)
        out = rows if out is None else out.unionByName(rows)
    return out


LINKERS: dict[str, list[Callable[[KnowledgeGraph], DataFrame]]] = {
    "linker-rust": [rust_contains, rust_imports],
    "linker-api": [
        endpoint_examples,
        lambda g: endpoint_schemas(g, "request"),
        lambda g: endpoint_schemas(g, "response"),
        endpoint_implementations,
        documents_endpoints,
        fragment_uses,
        inline_conditions,
        returned_types,
        fragment_conditions,
        fragment_spreads,
    ],
    "linker-markdown": [document_containment, declared_references],
    "linker-js-ts": [js_imports],
    "adapter-ffa": [surface_links],
    "adapter-fba": [contract_links],
    "adapter-page-builder": [page_builder_links],
}


def either_end(relations: DataFrame, affected: DataFrame) -> DataFrame:
    """Relations of which an end is affected (id), each id once."""
    names, affected = relations.columns, stage(affected.select("id").distinct(), "affected")
    a = relations.join(affected.select(F.col("id").alias("src")), "src", "left_semi").select(*names)
    b = relations.join(affected.select(F.col("id").alias("dst")), "dst", "left_semi").select(*names)
    return a.union(b).dropDuplicates(["id"])


def rule_rows(g: KnowledgeGraph, linkers: dict[str, list[Callable[[KnowledgeGraph], DataFrame]]]) -> DataFrame | None:
    """Unfinished rows of all rules; None without any."""
    out = None
    for name, rules in linkers.items():
        rows = [rule(g) for rule in rules]
        if name == "linker-rust":
            calls = rust_calls(g)
            rows += [calls, tested_by(g, calls)]
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


def link(g: KnowledgeGraph, linkers: tuple[str, ...] = tuple(LINKERS), affected: DataFrame | None = None) -> DataFrame:
    """All relations that the linkers derive, each id once; with ``affected`` (id), those of which an end is affected."""
    rows = rule_rows(g, {name: LINKERS[name] for name in linkers})
    if rows is None:
        return g.relations.limit(0)
    out = finished(rows)
    return out if affected is None else either_end(out, affected)
