"""Registered queries: one for each checker and linker rule, over a graph made of a whole table's rows, with their SQL.

Ids are the stable keys. What an entity declares depends on its row, so every rule finds some rows in order and some not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import KnowledgeGraph, conform
from graphloom.operators import check as C
from graphloom.operators import link as L
from graphloom.sources.testdata import dealt, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def parts(spark, sf) -> DataFrame:
    return dealt(read(spark, sf, "part"), "p_partkey").selectExpr("*", "p_partkey as k", "cast(p_partkey as string) as s")


def entities(df: DataFrame, kind: str, key: str, payload: str = "'{}'", name: str = "s", path: str = "concat('src/', s)", open_kind: bool = False) -> DataFrame:
    """Entities of a table's rows; all but the kind are SQL expressions."""
    rows = df.selectExpr(f"{key} as id", f"{key} as stable_key", f"{name} as name", f"named_struct('path', {path}, 'line_start', 1, 'line_end', 1) as source", f"{payload} as payload")
    return conform(rows.withColumns({"kind": F.lit("other" if open_kind else kind), "kind_other": F.lit(kind if open_kind else None).cast("string")}), "entities")


def relations(df: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    return conform(df.selectExpr(f"concat_ws('|', '{kind}', {src}, {dst}) as id", f"'{kind}' as kind", f"{src} as src", f"{dst} as dst"), "relations")


def facts(df: DataFrame, kind: str, subject: str, value: str, path: str = "concat('src/', s)") -> DataFrame:
    evidence = f"array(named_struct('source_file', {path}, 'line_start', 1, 'line_end', 1, 'extractor', 'x', 'commit_hash', cast(null as string), 'confidence', cast(1 as float), 'status', 'verified'))"
    return conform(df.selectExpr(f"concat_ws('|', '{kind}', {subject}, {value}) as id", "'other' as kind", f"'{kind}' as kind_other", f"{subject} as subject", f"{value} as value", f"{evidence} as evidence"), "facts")


def graph_of(spark, entities: list[DataFrame], relations: list[DataFrame] | None = None, facts: list[DataFrame] | None = None) -> KnowledgeGraph:
    g = KnowledgeGraph.empty(spark)
    union = lambda x, none: reduce(DataFrame.unionByName, x) if x else none
    return g.with_tables(entities=union(entities, g.entities), relations=union(relations, g.relations), facts=union(facts, g.facts))


def found(rows: DataFrame) -> DataFrame:
    """(kind, scope, key, detail) of what a checker's rule found."""
    p = lambda f: F.coalesce(F.get_json_object("payload", f"$.{f}"), F.lit(""))
    return rows.select(F.coalesce("kind_other", "kind").alias("kind"), p("scope").alias("scope"), F.get("entities", F.lit(0)).alias("key"), p("detail").alias("detail"))


def linked(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("kind_other", "kind").alias("kind"), "src", "dst")


def finding(kind: str, key: str, detail: str, where: str, scope: str = "", table: str = "part") -> str:
    """SQL of one kind of finding over rows of part, numbered ``k``."""
    return f"SELECT '{kind}' AS kind, '{scope}' AS scope, {key} AS key, {detail} AS detail FROM (SELECT *, p_partkey AS k FROM {table}) WHERE {where}"


def findings(*x: str) -> str:
    return " UNION ALL ".join(x)


# --- endpoints


REST, GQL = "concat('rest://', s)", "concat('gql://', s)"
AS_REST, AS_GQL = "'rest://' || k", "'gql://' || k"


def endpoint_pairs(spark, sf, rest: str, graphql: str) -> KnowledgeGraph:
    """A REST and a GraphQL endpoint of each part, of the same operation, with these further fields."""
    p = parts(spark, sf)
    return graph_of(spark, [entities(p, "api_endpoint", REST, f"to_json(named_struct('protocol', 'rest', 'operation_id', concat('load_part_', s), {rest}))"), entities(p, "api_endpoint", GQL, f"to_json(named_struct('protocol', 'graphql', 'operation_name', concat('loadPart', s), {graphql}))")])


def shape(*fields: tuple[str, str, str, str]) -> str:
    """SQL array of fields (name, type, required, condition)."""
    return "filter(array(" + ", ".join(f"if({c}, named_struct('name', '{n}', 'type', {t}, 'required', {r}), null)" for n, t, r, c in fields) + "), x -> x is not null)"


@query(finding("api_endpoint_documented_but_not_implemented", AS_REST, "''", "p_size <= 25"))
def rule_endpoint_not_implemented(spark, sf):
    p = parts(spark, sf)
    return found(C.not_implemented(graph_of(spark, [entities(p, "api_endpoint", REST)], [relations(p.where("p_size > 25"), "implemented_by", REST, "concat('fn://', s)")])))


@query(finding("api_endpoint_implemented_but_not_documented", AS_REST, "''", "p_size > 25 AND k % 4 <> 0"))
def rule_endpoint_not_documented(spark, sf):
    p = parts(spark, sf)
    known = [relations(p.where("p_size > 25"), "implemented_by", REST, "concat('fn://', s)"), relations(p.where("k % 4 = 0"), "documents_api", "concat('doc://', s)", REST)]
    return found(C.not_documented(graph_of(spark, [entities(p, "api_endpoint", REST)], known)))


def _schema_use(side: str):
    def run(spark, sf):
        p = parts(spark, sf)
        uses = f"to_json(named_struct('{side}_schemas', array(concat('#/components/schemas/S', s), 'https://else.where/x')))"
        g = graph_of(spark, [entities(p, "api_endpoint", REST, uses), entities(p, "api_schema", "concat('schema://', s)", name="concat('S', s)")], [relations(p.where("k % 3 = 0"), f"schema_for_{side}", REST, "concat('schema://', s)")])
        return found(C.schema_unresolved(g, side))

    run.__name__ = f"rule_{side}_schema_unresolved"
    return run


for _side in ("request", "response"):
    query(finding(f"api_{_side}_schema_mismatch", AS_REST, "'#/components/schemas/S' || k", "k % 3 <> 0"))(_schema_use(_side))


@query(finding("api_example_invalid", "'example://' || k", "'$.size: too large'", "p_size > 25"))
def rule_invalid_example(spark, sf):
    payload = "to_json(named_struct('value', named_struct('size', p_size), 'schema', named_struct('type', 'object', 'properties', named_struct('size', named_struct('type', 'integer', 'maximum', 25)))))"
    return found(C.invalid_examples(graph_of(spark, [entities(parts(spark, sf), "api_example", "concat('example://', s)", payload)])))


@query(finding("api_response_schema_mismatch", AS_REST, "concat_ws(',', CASE WHEN k % 2 = 1 THEN 'brand' END, CASE WHEN k % 3 = 0 THEN 'size' END)", "k % 2 = 1 OR k % 3 = 0", "parity"))
def rule_response_field_drift(spark, sf):
    own = ("id", "'string'", "true", "true")
    return found(C.response_field_drift(endpoint_pairs(spark, sf, f"'response_fields', {shape(own, ('brand', "'string'", 'false', 'k % 2 = 1'))}", f"'response_fields', {shape(own, ('size', "'Int'", 'false', 'k % 3 = 0'))}")))


SHAPES = (
    shape(("id", "'integer'", "true", "true"), ("name", "'string'", "false", "true"), ("size", "'integer'", "false", "k % 5 = 0")),
    shape(("id", "if(k % 2 = 0, 'Int', 'ID')", "true", "true"), ("name", "'String'", "k % 3 = 0", "true"), ("brand", "'String'", "false", "k % 7 = 0")),
)


def _shape_findings(scope: str) -> str:
    return findings(*(finding("api_request_schema_mismatch", AS_REST, f"'{d}'", w, scope) for d, w in (("type id", "k % 2 = 1"), ("required name", "k % 3 = 0"), ("missing size", "k % 5 = 0"), ("extra brand", "k % 7 = 0"))))


@query(_shape_findings("request"))
def rule_request_drift(spark, sf):
    return found(C.request_drift(endpoint_pairs(spark, sf, f"'request_fields', {SHAPES[0]}", f"'request_fields', {SHAPES[1]}")))


@query(_shape_findings("external_request"))
def rule_external_request_drift(spark, sf):
    g = endpoint_pairs(spark, sf, f"'external_request_fields', {SHAPES[0]}", f"'external_request_fields', {SHAPES[1]}")
    return found(C.request_drift(g, "external_request_fields", "external_request"))


@query(findings(finding("api_request_schema_mismatch", AS_REST, "'required id'", "k % 2 = 1", "parameters"), finding("api_request_schema_mismatch", AS_REST, "'missing q'", "k % 3 = 0", "parameters")))
def rule_parameter_drift(spark, sf):
    rest = "'parameters', array(named_struct('name', 'id', 'in', 'path', 'type', 'integer'), named_struct('name', 'q', 'in', 'query', 'type', 'string'))"
    var = "'variable_definitions', filter(array(named_struct('name', 'id', 'type', if(k % 2 = 0, 'Int!', 'Int')), if(k % 3 = 0, null, named_struct('name', 'q', 'type', 'String')), named_struct('name', 'more', 'type', 'String')), x -> x is not null)"
    return found(C.parameter_drift(endpoint_pairs(spark, sf, rest, var)))


@query(finding("api_response_schema_mismatch", AS_REST, "'missing name'", "k % 2 = 1", "schema"))
def rule_response_schema_drift(spark, sf):
    text = lambda n, c="true": (n, "'String'", "false", c)
    roots = f"'response_roots', array(named_struct('root', 'far', 'fields', {shape(('id', "'Int'", 'false', 'true'), text('z'))}), named_struct('root', 'near', 'fields', {shape(text('id'), text('name', 'k % 2 = 0'))}))"
    return found(C.response_schema_drift(endpoint_pairs(spark, sf, f"'response_fields', {shape(text('id'), text('name'))}", roots)))


@query(findings(finding("api_status_code_undocumented", AS_REST, "'success'", "k % 3 = 0"), *(finding("api_status_code_undocumented", AS_REST, f"'{c}'", "k % 2 = 0 AND k % 5 <> 0") for c in (401, 403))))
def rule_status_drift(spark, sf):
    rest = "'responses', filter(array(if(k % 3 = 0, null, '200'), '404', if(k % 5 = 0, '4XX', null)), x -> x is not null), 'authentication_required', k % 2 = 0"
    return found(C.status_drift(endpoint_pairs(spark, sf, rest, "'operation_type', 'query'")))


@query(finding("api_auth_requirement_mismatch", AS_REST, "CASE WHEN (k % 2 = 0) <> (k % 5 <> 0) THEN 'required' ELSE 'family' END", "(k % 2 = 0) <> (k % 5 <> 0) OR (k % 5 <> 0 AND k % 3 = 0)"))
def rule_authentication_drift(spark, sf):
    rest = "'authentication_required', k % 2 = 0, 'security_requirements', array(named_struct('families', array(if(k % 3 = 0, 'apiKey', 'bearer')), 'permissions', cast(array() as array<string>)))"
    graphql = "'directive_applications', filter(array(if(k % 5 = 0, null, named_struct('name', 'auth', 'arguments', cast(array() as array<string>)))), x -> x is not null)"
    return found(C.authentication_drift(endpoint_pairs(spark, sf, rest, graphql)))


@query(finding("api_permission_mismatch", AS_REST, "'p0,p' || (k % 3)", "k % 2 = 0 AND k % 3 <> 0"))
def rule_permission_drift(spark, sf):
    rest = "'authentication_required', k % 2 = 0, 'security_requirements', array(named_struct('families', array('apiKey'), 'permissions', array('admin')), named_struct('families', array('bearer'), 'permissions', array('admin', 'p0')))"
    graphql = "'directive_applications', array(named_struct('name', 'hasRole', 'arguments', array('admin', concat('p', cast(k % 3 as string)))))"
    return found(C.permission_drift(endpoint_pairs(spark, sf, rest, graphql)))


@query("SELECT 'gql://' || p_partkey AS key, p_partkey % 3 <> 0 AS required, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'bearer' ELSE 'apiKey' END AS families, CASE p_partkey % 3 WHEN 2 THEN 'read' ELSE '' END AS permissions FROM part")
def rule_directive_mapping(spark, sf):
    graphql = "'directive_applications', array(named_struct('name', element_at(array('other', 'auth', 'custom'), cast(k % 3 + 1 as int)), 'arguments', array('x')))"
    mapping = spark.createDataFrame([(None, "custom", "apiKey", "read")], "operation string, directive string, family string, permission string")
    d = C.directive_requirements(endpoint_pairs(spark, sf, "'x', 1", graphql), mapping)
    return d.select(F.col("stable_key").alias("key"), "required", F.array_join("families", ",").alias("families"), F.array_join("permissions", ",").alias("permissions"))


TYPES = {"ID!": "string", "[Int!]!": "[number]", "Float": "number", "Boolean": "boolean", "JSON": "object", "[[String]]": "[[string]]", "Part": "part", "": "unknown"}


@query("SELECT p_partkey AS k, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(TYPES.values())) + " END AS family FROM part")
def rule_type_family(spark, sf):
    return parts(spark, sf).select("k", C.type_family(F.element_at(F.array(*map(F.lit, TYPES)), (F.col("k") % 8 + 1).cast("int"))).alias("family"))


# --- documents and operations


@query(findings(finding("documentation_reference_unresolved", "'doc://' || k", "'fn://' || k", "p_size > 25"), finding("documentation_reference_unresolved", "'doc://' || k", "'twice'", "k % 2 = 0", "ambiguous")))
def rule_document_references(spark, sf):
    p = parts(spark, sf)
    page = "to_json(named_struct('entities', filter(array(concat('fn://', s), if(k % 2 = 0, 'twice', null)), x -> x is not null)))"
    two = spark.range(2).selectExpr("'x' as s", "'twice' as t")
    g = graph_of(spark, [entities(p, "documentation_page", "concat('doc://', s)", page), entities(p.where("p_size <= 25"), "function", "concat('fn://', s)"), entities(two, "function", "t")])
    return found(C.unresolved_reference(g)).unionByName(found(C.ambiguous_reference(g)))


@query("SELECT 'duplicate_documentation_id' AS kind, '' AS scope, 'brand://' || p_brand AS key, 'src/' || p_partkey AS detail FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1)")
def rule_duplicate_document(spark, sf):
    return found(C.duplicate_document(graph_of(spark, [entities(parts(spark, sf), "documentation_page", "concat('brand://', p_brand)")])))


OPERATIONS = {"env": "env_var", "config": "feature", "scripts": "script_command", "deployment": "docker_service"}


@query(findings(*(finding("missing_documentation", f"'{s}://' || k", "''", "k % 2 = 1", s) for s in OPERATIONS)))
def rule_undocumented(spark, sf):
    p = parts(spark, sf)
    rows = []
    for scope, kind in OPERATIONS.items():
        key = f"concat('{scope}://', s)"
        g = graph_of(spark, [entities(p, kind, key, "to_json(named_struct('feature_kind', 'runtime_config_key'))")], [relations(p.where("k % 2 = 0"), "documents", "concat('doc://', s)", key)])
        rows.append(found(C.undocumented(g, scope)))
    return reduce(DataFrame.unionByName, rows)


@query(findings(
    finding("missing_documentation", "'runbook://' || k", "''", "k % 5 = 0", "runbooks"), finding("missing_documentation", "'runbook://' || k", "''", "k % 5 = 1", "runbook_steps"),
    finding("stale_documentation", "'runbook://' || k", "''", "k % 5 = 2", "runbooks"), finding("stale_documentation", "'runbook://' || k", "'script://beta' || k", "k % 5 = 3", "runbooks"),
))
def rule_runbooks(spark, sf):
    p = parts(spark, sf)
    book, step = "concat('runbook://', s)", "concat('runbook://', s, '#step-1')"
    targets = "to_json(named_struct('targets', if(k % 5 = 0, cast(array() as array<string>), array(concat('script://alpha', s), concat('script://beta', s)))))"
    steps = p.where("k % 5 <> 1")
    text = "to_json(named_struct('text', case k % 5 when 2 then 'wait' when 3 then concat('run alpha', s) else concat('run alpha', s, ' and BETA', s) end))"
    scripts = [entities(p, "script", f"concat('script://{w}', s)", name=f"concat('{w}', s)") for w in ("alpha", "beta")]
    g = graph_of(spark, [entities(p, "runbook", book, targets), entities(steps, "operation_step", step, text), *scripts], [relations(steps, "contains", book, step)])
    return found(C.runbook_findings(g))


@query(findings(
    finding("graphql_fragment_unresolved", AS_GQL, "'F' || k % 4", "k % 4 > 1"), finding("graphql_type_condition_unresolved", AS_GQL, "'T' || k % 3", "k % 3 <> 0"), finding("graphql_variable_undeclared", AS_GQL, "'b'", "k % 2 = 1"),
    finding("graphql_variable_unused", AS_GQL, "'c'", "true"), finding("graphql_variable_type_unresolved", AS_GQL, "'T' || k % 3", "k % 3 <> 0"),
))
def rule_graphql_documents(spark, sf):
    p = parts(spark, sf)
    t = "concat('T', cast(k % 3 as string))"
    op = f"to_json(named_struct('protocol', 'graphql', 'fragment_spreads', array(concat('F', cast(k % 4 as string))), 'inline_type_conditions', array({t}), 'variables', filter(array('a', if(k % 2 = 1, 'b', null)), x -> x is not null), 'variable_definitions', array(named_struct('name', 'a', 'type', concat('[', {t}, '!]!')), named_struct('name', 'c', 'type', 'Int'))))"
    fragments = spark.range(2).selectExpr("concat('F', cast(id as string)) as s")
    schema = spark.range(1).selectExpr("'T0' as s")
    g = graph_of(spark, [entities(p, "api_endpoint", GQL, op), entities(fragments, "graphql_fragment", "concat('frag://', s)", open_kind=True), entities(schema, "api_schema", "concat('type://', s)", "to_json(named_struct('protocol', 'graphql'))")])
    return found(C.graphql_findings(g))


# --- surfaces, contracts, page builder


def surfaces(spark, sf) -> tuple[KnowledgeGraph, DataFrame]:
    p = parts(spark, sf)
    mark = lambda role, marker, where: facts(p.where(where), "ffa_layer_marker", f"concat('ffa_layer://m', s, '/web/{role}')", f"to_json(named_struct('module', concat('m', s), 'surface', 'web', 'role', '{role}', 'marker', {marker}))")
    marks = [
        mark("core", "if(k % 4 = 0, 'imports_ui', null)", "k % 2 = 0"), mark("transport", "if(k % 6 = 0, 'profile', null)", "k % 3 = 0"), mark("ui", "if(k % 10 = 0, 'raw_transport', null)", "k % 5 = 0"), mark("host", "if(k % 7 = 0, 'owns_ui', null)", "true"),
        facts(p, "ffa_docs_status", "concat('m', s)", "to_json(named_struct('module', concat('m', s), 'surface', 'web', 'shape', 'core+host'))"),
    ]
    layer = [entities(p.where(w), "ffa_layer", f"concat('ffa_layer://m', s, '/web/{r}')", open_kind=True) for r, w in (("core", "k % 2 = 0"), ("host", "true"))]
    return graph_of(spark, [entities(p, "ffa_surface", "concat('ffa_surface://m', s, '/web')", open_kind=True), *layer, entities(p, "file", "concat('file://src/', s)")], facts=marks), p


SURFACE = "'ffa_surface://m' || k || '/web'"


@query(findings(*(finding(f"ffa_{n}", SURFACE, "''", w) for n, w in (
    ("core_depends_on_ui", "k % 4 = 0"), ("ui_raw_transport", "k % 10 = 0"), ("host_owns_ui", "k % 7 = 0"), ("missing_core", "k % 2 <> 0"), ("missing_transport", "k % 3 <> 0"), ("missing_ui", "k % 5 <> 0"),
    ("transport_profile_missing", "k % 3 = 0 AND k % 6 <> 0"), ("forgotten_surface", "k % 2 <> 0 AND k % 3 <> 0 AND k % 5 <> 0")))))
def rule_surfaces(spark, sf):
    return found(C.surface_findings(surfaces(spark, sf)[0]))


SEEN = "concat_ws('+', CASE WHEN k % 2 = 0 THEN 'core' END, 'host', CASE WHEN k % 3 = 0 THEN 'transport' END, CASE WHEN k % 5 = 0 THEN 'ui' END)"


@query(finding("ffa_docs_drift", SURFACE, f"'core+host ' || {SEEN}", f"{SEEN} <> 'core+host'"))
def rule_surface_docs_drift(spark, sf):
    return found(C.surface_docs_drift(surfaces(spark, sf)[0]))


@query("SELECT 'contains' AS kind, 'ffa_surface://m' || p_partkey || '/web' AS src, 'ffa_layer://m' || p_partkey || '/web/' || r AS dst FROM part, (VALUES ('core'), ('host')) v(r) WHERE r = 'host' OR p_partkey % 2 = 0 UNION ALL SELECT 'implemented_by', 'ffa_layer://m' || p_partkey || '/web/' || r, 'file://src/' || p_partkey FROM part, (VALUES ('core'), ('host')) v(r) WHERE r = 'host' OR p_partkey % 2 = 0")
def rule_surface_links(spark, sf):
    return linked(L.surface_links(surfaces(spark, sf)[0]))


def contracts(spark, sf) -> KnowledgeGraph:
    """A module of each part: a provider with one port, or none; its code, its dependencies and what documents say of it."""
    p = parts(spark, sf)
    module = "concat('fba_module://m', s)"
    port = "named_struct('name', 'store', 'trait', 'Store', 'operations', array(named_struct('name', 'get', 'write', false, 'idempotent', false), named_struct('name', 'put', 'write', true, 'idempotent', k % 2 = 0)), 'context', if(k % 3 = 0, null, 'c'), 'error', if(k % 5 = 0, null, 'e'), 'policy', 'p')"
    payload = f"to_json(named_struct('role', 'provider', 'ports', if(k % 11 = 0, array(), array({port})), 'evidence', if(k % 7 = 0, cast(array() as array<string>), array('x')), 'tests_locked', k % 4 = 0, 'status', if(k % 2 = 0, 'ready', 'draft'), 'contract', 'v1', 'profiles', array('fast'), 'consumers', array(concat('u', s)), 'fallback', 'none', 'degraded', 'read'))"
    own = f"to_json(named_struct('contract', if(k % 3 = 0, 'v2', 'v1'), 'profile', if(k % 4 = 0, 'slow', 'fast'), 'fallback', if(k % 5 = 0, 'cache', 'none'), 'degraded', 'read'))"
    code = "to_json(named_struct('module', concat('m', s), 'port', 'Store', 'operations', if(k % 9 = 0, array('get'), array('get', 'put'))))"
    return graph_of(
        spark,
        [
            entities(p, "fba_module", module, payload, open_kind=True), entities(p, "fba_contract", "concat('fba_contract://m', s, '/v1')", open_kind=True), entities(p, "fba_port", "concat('fba_port://m', s, '/store')", open_kind=True),
            entities(p, "fba_operation", "concat('fba_operation://m', s, '/store/get')", open_kind=True), entities(p, "fba_dependency", "concat('fba_dependency://', if(k % 6 = 0, 'other', concat('u', s)), '/', if(k % 8 = 0, 'nobody', concat('m', s)), '/', s)", own, open_kind=True),
            entities(p, "fba_module", "concat('fba_module://u', s)", "to_json(named_struct('evidence', array('x'), 'tests_locked', true, 'role', 'consumer'))", open_kind=True),
        ],
        facts=[facts(p.where("k % 13 <> 0"), "fba_port_code", "concat('m', s)", code), facts(p.where("k % 17 = 0"), "fba_port_code", "concat('fba_code://x', s)", "to_json(named_struct('module', concat('x', s), 'port', 'Store', 'operations', array('get')))"), facts(p, "fba_docs_status", "concat('m', s)", "to_json(named_struct('module', concat('m', s), 'status', 'ready'))")],
    )


MODULE = "'fba_module://m' || k"
LIVE = "k % 11 <> 0 AND k % 13 <> 0"


@query(findings(
    finding("fba_provider_without_ports", MODULE, "''", "k % 11 = 0"), finding("fba_evidence_missing", MODULE, "''", "k % 7 = 0"), finding("fba_tests_not_locked", MODULE, "''", "k % 4 <> 0"), finding("fba_port_trait_missing", MODULE, "'store'", "k % 11 <> 0 AND k % 13 = 0"),
    finding("fba_port_operation_missing", MODULE, "'store/put'", f"{LIVE} AND k % 9 = 0"), finding("fba_port_context_missing", MODULE, "'store'", f"{LIVE} AND k % 3 = 0"), finding("fba_port_error_missing", MODULE, "'store'", f"{LIVE} AND k % 5 = 0"),
    finding("fba_operation_idempotency_unasserted", MODULE, "'store/put'", f"{LIVE} AND k % 2 = 1"), finding("fba_code_without_registry", "'fba_code://x' || k", "''", "k % 17 = 0"),
))
def rule_contracts(spark, sf):
    return found(C.contract_findings(contracts(spark, sf)))


DEPENDENCY = "'fba_dependency://' || CASE WHEN k % 6 = 0 THEN 'other' ELSE 'u' || k END || '/' || CASE WHEN k % 8 = 0 THEN 'nobody' ELSE 'm' || k END || '/' || k"


@query(findings(finding("fba_provider_unresolved", DEPENDENCY, "''", "k % 8 = 0"), *(finding(f"fba_{n}_mismatch", DEPENDENCY, f"'{d}'", f"k % 8 <> 0 AND {w}") for n, d, w in (("contract", "v2", "k % 3 = 0"), ("profile", "slow", "k % 4 = 0"), ("fallback", "cache", "k % 5 = 0"), ("consumer", "other", "k % 6 = 0")))))
def rule_dependencies(spark, sf):
    return found(C.dependency_findings(contracts(spark, sf)))


@query(finding("fba_docs_drift", MODULE, "'ready draft'", "k % 2 = 1"))
def rule_contract_docs_drift(spark, sf):
    return found(C.contract_docs_drift(contracts(spark, sf)))


def _arc(kind: str, src: str, dst: str, where: str = "true") -> str:
    return f"SELECT '{kind}' AS kind, {src} AS src, {dst} AS dst FROM (SELECT *, p_partkey AS k FROM part) WHERE {where}"


@query(findings(
    _arc("contains", MODULE, "'fba_contract://m' || k || '/v1'"), _arc("contains", MODULE, "'fba_port://m' || k || '/store'"), _arc("contains", "'fba_port://m' || k || '/store'", "'fba_operation://m' || k || '/store/get'"),
    _arc("requires_dependency", "'fba_module://u' || k", DEPENDENCY, "k % 6 <> 0"), _arc("consumer_requires_provider", DEPENDENCY, MODULE, "k % 8 <> 0"),
))
def rule_contract_links(spark, sf):
    return linked(L.contract_links(contracts(spark, sf)))


def page_builders(spark, sf) -> KnowledgeGraph:
    p = parts(spark, sf)
    consumer = "concat('page_builder_consumer://', s)"
    own = "to_json(named_struct('provider', if(k % 7 = 0, 'page_builder_provider://none', concat('page_builder_provider://', s)), 'contract', 'c1', 'version', if(k % 3 = 0, '2', '1'), 'content_format', 'json', 'capabilities', if(k % 2 = 0, array('edit'), array('edit', 'view')), 'profiles', array('wide'), 'seams', if(k % 5 = 0, array('render', 'load'), array('render', 'load', 'save')), 'wave_evidence', array(named_struct('name', 'w1', 'evidence', if(k % 4 = 0, null, 'e'), 'fresh', k % 3 <> 0))))"
    theirs = f"to_json(named_struct('consumers', if(k % 11 = 0, cast(array() as array<string>), array({consumer})), 'contract', 'c1', 'version', '1', 'content_format', 'json', 'capabilities', array('edit', 'view'), 'profiles', array('wide')))"
    return graph_of(spark, [entities(p, "page_builder_consumer", consumer, own, open_kind=True), entities(p, "page_builder_provider", "concat('page_builder_provider://', s)", theirs, open_kind=True), entities(spark.range(1).selectExpr("'wide' as s"), "page_builder_profile", "s", open_kind=True)])


CONSUMER, REGISTERED = "'page_builder_consumer://' || k", "k % 7 <> 0 AND k % 11 <> 0"


@query(findings(
    finding("page_builder_consumer_unregistered", CONSUMER, "''", f"NOT ({REGISTERED})"), finding("page_builder_version_mismatch", CONSUMER, "'2 1'", f"{REGISTERED} AND k % 3 = 0"), finding("page_builder_capabilities_mismatch", CONSUMER, "'view'", f"{REGISTERED} AND k % 2 = 0"),
    finding("page_builder_seam_missing", CONSUMER, "'save'", f"{REGISTERED} AND k % 5 = 0"), finding("page_builder_wave_evidence_missing", CONSUMER, "'w1'", f"{REGISTERED} AND k % 4 = 0"), finding("page_builder_wave_evidence_stale", CONSUMER, "'w1'", f"{REGISTERED} AND k % 4 <> 0 AND k % 3 = 0"),
))
def rule_page_builder(spark, sf):
    return found(C.page_builder_findings(page_builders(spark, sf)))


@query(findings(_arc("page_builder_consumes_provider", CONSUMER, "'page_builder_provider://' || k", "k % 7 <> 0"), _arc("page_builder_uses_profile", CONSUMER, "'wide'")))
def rule_page_builder_links(spark, sf):
    return linked(L.page_builder_links(page_builders(spark, sf)))


# --- linkers


def crates(spark, sf) -> KnowledgeGraph:
    """A crate of each brand; a module of each part that imports another part's function, which its own function calls by its last name."""
    p = parts(spark, sf)
    rust = lambda kind, qn, payload="": entities(p, kind, f"concat('symbol://rust:', {qn})", f"to_json(named_struct('qualified_name', {qn}{payload}))", name=qn)
    return graph_of(spark, [
        rust("module", "concat('app::m', s)", ", 'imports', array(concat('crate::m', cast(k + 1 as string), '::f'), 'std::fmt')"),
        rust("function", "concat('app::m', s, '::f')"),
        rust("function", "concat('app::m', s, '::g')", ", 'calls', array('f', 'super::g', concat('crate::m', cast(k + 2 as string), '::f'))"),
        rust("test_case", "concat('app::m', s, '::t')", ", 'calls', array('self::g')"),
    ])


def _symbol(qn: str) -> str:
    return f"'symbol://rust:app::m' || {qn}"


HAS = "EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = k + {})"


@query(findings(*(_arc("contains", _symbol("k"), _symbol(f"k || '::{x}'")) for x in "fgt")))
def rule_rust_contains(spark, sf):
    return linked(L.rust_contains(crates(spark, sf)))


@query(_arc("imports", _symbol("k"), _symbol("(k + 1) || '::f'"), HAS.format(1)))
def rule_rust_imports(spark, sf):
    return linked(L.rust_imports(crates(spark, sf)))


@query(findings(_arc("calls", _symbol("k || '::g'"), _symbol("k || '::f'")), _arc("calls", _symbol("k || '::g'"), _symbol("(k + 2) || '::f'"), HAS.format(2)), _arc("calls", _symbol("k || '::t'"), _symbol("k || '::g'"))))
def rule_rust_calls(spark, sf):
    return linked(L.rust_calls(crates(spark, sf)))


@query(_arc("tested_by", _symbol("k || '::g'"), _symbol("k || '::t'")))
def rule_rust_tested_by(spark, sf):
    g = crates(spark, sf)
    return linked(L.tested_by(g, L.rust_calls(g)))


def contracts_of_parts(spark, sf) -> KnowledgeGraph:
    p = parts(spark, sf)
    uses = lambda side: f"'{side}_schemas', array(concat('#/components/schemas/S', cast(k + {1 if side == 'request' else 0} as string)))"
    endpoint = f"to_json(named_struct('operation_id', concat('load_part_', s), {uses('request')}, {uses('response')}))"
    return graph_of(spark, [
        entities(p, "api_endpoint", REST, endpoint, path="concat('spec/', cast(k div 10 as string))"), entities(p, "api_schema", "concat('schema://', s)", name="concat('S', s)", path="concat('spec/', cast(k div 10 as string))"),
        entities(p, "api_example", "concat('example://', s)", "to_json(named_struct('endpoint', concat('rest://', cast(k + 1 as string))))"), entities(p.where("k % 2 = 0"), "function", "concat('fn://', s)", name="concat('loadPart', s)"),
    ])


@query(_arc("example_for", "'example://' || k", "'rest://' || (k + 1)", HAS.format(1)))
def rule_endpoint_examples(spark, sf):
    return linked(L.endpoint_examples(contracts_of_parts(spark, sf)))


@query(findings(_arc("schema_for_request", AS_REST, "'schema://' || (k + 1)", "k % 10 <> 9 AND " + HAS.format(1)), _arc("schema_for_response", AS_REST, "'schema://' || k")))
def rule_endpoint_schemas(spark, sf):
    g = contracts_of_parts(spark, sf)
    return linked(L.endpoint_schemas(g, "request").unionByName(L.endpoint_schemas(g, "response")))


@query(_arc("implemented_by", AS_REST, "'fn://' || k", "k % 2 = 0"))
def rule_endpoint_implementations(spark, sf):
    return linked(L.endpoint_implementations(contracts_of_parts(spark, sf)))


def operations(spark, sf) -> KnowledgeGraph:
    """An operation, a fragment and a type of each part; the Query type has a member for each brand, of the type of its least part."""
    p = parts(spark, sf)
    op = "to_json(named_struct('protocol', 'graphql', 'operation_type', 'query', 'selection_roots', array(p_brand), 'fragment_spreads', array(concat('F', s)), 'inline_type_conditions', array(concat('T', cast(k + 1 as string)))))"
    fragment = "to_json(named_struct('type_condition', concat('T', s), 'fragment_spreads', array(concat('F', cast(k + 1 as string)))))"
    members = p.groupBy("p_brand").agg(F.min("k").cast("string").alias("k")).agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("[T"), "k", F.lit("!]")).alias("type"))).alias("m"))
    root = members.selectExpr("'Query' as s", "to_json(named_struct('protocol', 'graphql', 'member_types', m)) as p")
    return graph_of(spark, [entities(p, "api_endpoint", GQL, op), entities(p, "graphql_fragment", "concat('frag://', s)", fragment, name="concat('F', s)", open_kind=True), entities(p, "api_schema", "concat('type://T', s)", "to_json(named_struct('protocol', 'graphql'))", name="concat('T', s)"), entities(root, "api_schema", "'type://Query'", "p")])


@query(_arc("graphql_uses_fragment", AS_GQL, "'frag://' || k"))
def rule_operation_fragments(spark, sf):
    return linked(L.fragment_uses(operations(spark, sf)))


@query(_arc("graphql_inline_type_condition", AS_GQL, "'type://T' || (k + 1)", HAS.format(1)))
def rule_inline_conditions(spark, sf):
    return linked(L.inline_conditions(operations(spark, sf)))


@query("SELECT 'graphql_operation_queries_type' AS kind, 'gql://' || p_partkey AS src, 'type://T' || m AS dst FROM part JOIN (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY p_brand) USING (p_brand)")
def rule_returned_types(spark, sf):
    return linked(L.returned_types(operations(spark, sf)))


@query(_arc("graphql_fragment_type_condition", "'frag://' || k", "'type://T' || k"))
def rule_fragment_conditions(spark, sf):
    return linked(L.fragment_conditions(operations(spark, sf)))


@query(_arc("graphql_fragment_spread_resolution", "'frag://' || k", "'frag://' || (k + 1)", HAS.format(1)))
def rule_fragment_spreads(spark, sf):
    return linked(L.fragment_spreads(operations(spark, sf)))
