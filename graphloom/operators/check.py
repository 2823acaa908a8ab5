"""Checkers: integrity rules that derive diagnostics.

A rule yields (id, stable_key, path, detail) of what it finds wrong; ``emit`` makes diagnostics of them. Most are one of four shapes:
a filter, a key that nothing has (anti-join), a key that several have, or two sets that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.text import fnv1a64, named_type, normalized
from graphloom.model import EVIDENCE, KnowledgeGraph, conform
from graphloom.operators.link import field, of_kind, strings

DOCUMENTS = ("documents", "documents_api", "documents_operation")
TARGETS = ("api_endpoint", "function", "script", "script_command", "docker_service", "ci_job", "env_var", "feature", "db_migration", "package")
NONE = "array<string>"


def emit(found: DataFrame, kind: str, severity: str, checker: str, message: str, fix: str | None = None, scope: str | None = None, open_kind: bool = False, snapshot: str = "") -> DataFrame:
    """Diagnostics of (id, stable_key, path, detail[, module]), with the text that ``finished`` makes an id of."""
    detail = F.coalesce("detail", F.lit(""))
    one = F.struct(F.col("path").alias("source_file"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(checker).alias("extractor"), F.lit(None).cast("string").alias("commit_hash"), F.lit(1.0).cast("float").alias("confidence"), F.lit("verified").alias("status"))
    payload = F.to_json(F.struct(F.nullif(detail, F.lit("")).alias("detail"), *([F.col("module")] if "module" in found.columns else []), *([F.lit(scope).alias("scope")] if scope else [])))
    rows = found.select(
        F.lit(snapshot).alias("snapshot"),
        F.concat_ws("\0", F.lit(kind), F.lit(scope or ""), "stable_key", detail).alias("id_text"),
        F.lit("other" if open_kind else kind).alias("kind"),
        F.lit(kind if open_kind else None).cast("string").alias("kind_other"),
        F.lit(severity).alias("severity"),
        F.lit("open").alias("status"),
        F.lit(kind.replace("_", " ")).alias("title"),
        F.concat(F.lit(message + ": "), F.concat_ws(" ", "stable_key", F.nullif(detail, F.lit("")))).alias("message"),
        F.array("id").alias("entities"),
        F.array(one).cast(EVIDENCE).alias("evidence"),
        F.transform(F.array_compact(F.array("path")), lambda p: F.struct(p.alias("source_file"))).alias("ownership"),
        F.lit(fix).cast("string").alias("suggested_fix"),
        payload.alias("payload"),
    )
    return rows


def finished(rows: DataFrame) -> DataFrame:
    """Diagnostic rows with ids, one for each rule, scope, entity and detail."""
    return conform(rows.withColumn("id", F.concat(F.lit("diag_"), fnv1a64(F.col("id_text")))), "diagnostics").dropDuplicates(["id"])


def subject(df: DataFrame, detail: Column | None = None, *more: Column) -> DataFrame:
    return df.select("id", "stable_key", F.col("source.path").alias("path"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"), *more)


# --- shapes


def missing(entities: DataFrame, relations: DataFrame, end: str, *kinds: str) -> DataFrame:
    """Entities that are the ``end`` (src or dst) of no relation of these kinds."""
    return entities.join(relations.where(F.coalesce("kind_other", "kind").isin(*kinds)).select(F.col(end).alias("id")), "id", "left_anti")


def having(entities: DataFrame, relations: DataFrame, end: str, *kinds: str) -> DataFrame:
    return entities.join(relations.where(F.coalesce("kind_other", "kind").isin(*kinds)).select(F.col(end).alias("id")), "id", "left_semi")


def unresolved(declared: DataFrame, keys: DataFrame) -> DataFrame:
    """Declared rows (key, ...) whose key nothing has."""
    return declared.join(keys.select("key"), "key", "left_anti")


def ambiguous(declared: DataFrame, keys: DataFrame) -> DataFrame:
    """Declared rows (key, ...) whose key several have."""
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return declared.join(many, "key", "left_semi")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows that share their key with another."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), key, "left_semi")


def set_drift(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """(on, missing, extra): of pairs with two non-empty sets that differ, what only the left and only the right has."""
    both = left.join(right, on).where((F.size(a) > 0) & (F.size(b) > 0))
    out = both.select(*on, F.array_sort(F.array_except(a, b)).alias("missing"), F.array_sort(F.array_except(b, a)).alias("extra"))
    return out.where((F.size("missing") > 0) | (F.size("extra") > 0))


# --- documents


def page_without_title(g: KnowledgeGraph) -> DataFrame:
    return emit(subject(of_kind(g, "documentation_page").where(F.trim(F.coalesce("title", F.lit(""))) == "")), "documentation_page_missing_title", "medium", "checker-markdown", "page has no title", "add a heading of level one")


def empty_page(g: KnowledgeGraph) -> DataFrame:
    return emit(subject(missing(of_kind(g, "documentation_page"), g.relations, "src", "contains")), "empty_documentation_page", "low", "checker-markdown", "page has no section")


def _declared(g: KnowledgeGraph) -> tuple[DataFrame, DataFrame]:
    key = F.explode(F.array_distinct(F.concat(strings("entities"), strings("concepts"))))
    d = of_kind(g, "documentation_page").select("id", "stable_key", F.col("source.path").alias("path"), key.alias("key")).withColumn("detail", F.col("key"))
    return d, g.entities.select(F.col("stable_key").alias("key"))


def unresolved_reference(g: KnowledgeGraph) -> DataFrame:
    return emit(unresolved(*_declared(g)), "documentation_reference_unresolved", "medium", "checker-markdown", "page declares a key that nothing has")


def ambiguous_reference(g: KnowledgeGraph) -> DataFrame:
    return emit(ambiguous(*_declared(g)), "documentation_reference_unresolved", "medium", "checker-markdown", "page declares a key that several have", scope="ambiguous")


def duplicate_document(g: KnowledgeGraph) -> DataFrame:
    """Pages that share their id; one diagnostic for each page, told apart by its path."""
    return emit(subject(duplicates(of_kind(g, "documentation_page"), "stable_key"), F.col("source.path")), "duplicate_documentation_id", "high", "checker-markdown", "document id is of several pages")


# --- endpoints


def not_implemented(g: KnowledgeGraph) -> DataFrame:
    return emit(subject(missing(of_kind(g, "api_endpoint"), g.relations, "src", "implemented_by")), "api_endpoint_documented_but_not_implemented", "high", "checker-api", "endpoint has no implementation")


def not_documented(g: KnowledgeGraph) -> DataFrame:
    return emit(subject(missing(having(of_kind(g, "api_endpoint"), g.relations, "src", "implemented_by"), g.relations, "dst", *DOCUMENTS)), "api_endpoint_implemented_but_not_documented", "medium", "checker-api", "endpoint has no document")


def schema_unresolved(g: KnowledgeGraph, side: str) -> DataFrame:
    """Local schema references of requests or responses that no relation to a schema of that name meets."""
    use = F.explode(F.array_distinct(strings(f"{side}_schemas")))
    uses = of_kind(g, "api_endpoint").select("id", "stable_key", F.col("source.path").alias("path"), use.alias("u")).withColumn("detail", F.coalesce(F.get_json_object("u", "$.reference"), F.col("u"))).where(F.col("detail").startswith("#/"))
    names = g.entities.where("kind = 'api_schema'").select(F.col("id").alias("dst"), F.concat(F.lit("#/components/schemas/"), "name").alias("detail"))
    met = g.relations.where(F.col("kind") == f"schema_for_{side}").select(F.col("src").alias("id"), "dst").join(names, "dst").select("id", "detail")
    return emit(uses.join(met, ["id", "detail"], "left_anti").select("id", "stable_key", "path", "detail"), f"api_{side}_schema_mismatch", "high", "checker-api", "schema reference is unresolved")


def invalid_examples(g: KnowledgeGraph) -> DataFrame:
    """Examples whose value its schema does not allow.

    Payload: ``value`` and ``schema`` as JSON, ``schemas`` the components that references mean. Validation is of the subset
    of JSON Schema that ``schema_errors`` lists.
    """
    rows = of_kind(g, "api_example").select("id", "stable_key", F.col("source.path").alias("path"), "payload")

    def run(batches):
        import json

        for b in batches:
            errors = []
            for p in b["payload"]:
                x = json.loads(p or "{}")
                found = schema_errors(x["value"], x["schema"], x.get("schemas") or {}) if "schema" in x and "value" in x else []
                errors.append(found[0] if found else None)
            yield b.assign(detail=errors)[["id", "stable_key", "path", "detail"]]

    return emit(rows.mapInPandas(run, "id string, stable_key string, path string, detail string").where("detail is not null"), "api_example_invalid", "medium", "checker-api", "example does not match its schema")


def schema_errors(value, schema, components: dict | None = None, at: str = "$") -> list[str]:
    """Places and reasons for which a JSON value does not match: type, nullable, enum, const, required, properties, additionalProperties,
    items, lengths, bounds (exclusive as flag or number), pattern, allOf, anyOf, oneOf, not, $ref."""
    import re

    if schema is True or not isinstance(schema, dict):
        return [] if schema is not False else [f"{at}: nothing is allowed"]
    if "$ref" in schema:
        name = str(schema["$ref"]).rsplit("/", 1)[-1]
        return schema_errors(value, (components or {})[name], components, at) if name in (components or {}) else []
    out: list[str] = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    if value is None and (schema.get("nullable") or "null" in kinds):
        return []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    real = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number, "integer": number and float(value).is_integer()}
    if kinds and not any(real.get(k, True) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        own = schema.get("properties") or {}
        out += [f"{at}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        for k, v in value.items():
            if k in own:
                out += schema_errors(v, own[k], components, f"{at}.{k}")
            elif "additionalProperties" in schema and not any(re.search(p, k) for p in schema.get("patternProperties") or {}):
                out += [f"{at}.{k}: not allowed"] if schema["additionalProperties"] is False else schema_errors(v, schema["additionalProperties"], components, f"{at}.{k}")
    if isinstance(value, list):
        if "items" in schema:
            out += [e for i, v in enumerate(value) for e in schema_errors(v, schema["items"], components, f"{at}[{i}]")]
        out += [f"{at}: too few"] if len(value) < schema.get("minItems", 0) else []
        out += [f"{at}: too many"] if len(value) > schema.get("maxItems", len(value)) else []
        out += [f"{at}: repeated"] if schema.get("uniqueItems") and any(a == b for i, a in enumerate(value) for b in value[:i]) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
        out += [f"{at}: pattern"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
    if number:
        low, high = schema.get("minimum"), schema.get("maximum")
        below, above = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        out += [f"{at}: too small"] if (low is not None and (value < low or (below is True and value == low))) or (isinstance(below, (int, float)) and not isinstance(below, bool) and value <= below) else []
        out += [f"{at}: too large"] if (high is not None and (value > high or (above is True and value == high))) or (isinstance(above, (int, float)) and not isinstance(above, bool) and value >= above) else []
    for s in schema.get("allOf") or []:
        out += schema_errors(value, s, components, at)
    if schema.get("anyOf") and all(schema_errors(value, s, components, at) for s in schema["anyOf"]):
        out.append(f"{at}: matches none of anyOf")
    if schema.get("oneOf") and sum(not schema_errors(value, s, components, at) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: matches not exactly one of oneOf")
    if "not" in schema and not schema_errors(value, schema["not"], components, at):
        out.append(f"{at}: matches what it may not")
    return out


# --- REST against GraphQL


def endpoint_pairs(g: KnowledgeGraph) -> DataFrame:
    """(rest, graphql, ...) endpoints of the same normalized operation name, with both payloads."""
    e = of_kind(g, "api_endpoint").select("id", "stable_key", F.col("source.path").alias("path"), "payload", field("protocol").alias("protocol"), F.nullif(normalized(F.coalesce(field("operation_id"), field("operation_name"))), F.lit("")).alias("op"))
    rest = e.where("op is not null and coalesce(protocol, '') <> 'graphql'").select("op", "id", "stable_key", "path", F.col("payload").alias("rest"))
    return rest.join(e.where("op is not null and protocol = 'graphql'").select("op", F.col("stable_key").alias("graphql_key"), F.col("payload").alias("graphql")), "op")


FIELDS = "array<struct<name:string,type:string,required:boolean>>"


def fields_of(payload: str, name: str) -> Column:
    """A payload's fields as (name, type, required)."""
    return F.coalesce(F.from_json(F.get_json_object(payload, f"$.{name}"), FIELDS), F.array().cast(FIELDS))


def type_family(kind: Column) -> Column:
    """string, number, boolean, object or the named type of a REST or GraphQL type; lists keep their brackets."""
    name = named_type(F.coalesce(kind, F.lit("")))
    low = F.lower(name)
    base = (
        F.when(low.isin("string", "id", "date", "datetime", "uuid", "time"), "string")
        .when(low.isin("int", "integer", "float", "number", "long", "decimal"), "number")
        .when(low.isin("boolean", "bool"), "boolean")
        .when(low.isin("object", "json", "jsonobject"), "object")
        .when(low == "", "unknown")
        .otherwise(low)
    )
    depth = F.length(F.regexp_replace(F.coalesce(kind, F.lit("")), r"[^\[]", ""))
    return F.concat(F.repeat(F.lit("["), depth), base, F.repeat(F.lit("]"), depth))


def shape_mismatches(pairs: DataFrame, left: Column, right: Column, extras: bool = True) -> DataFrame:
    """(id, stable_key, path, detail): fields by name that one side lacks, or of another type family or requirement.

    ``detail`` is ``missing name``, ``extra name``, ``type name`` or ``required name``; without ``extras`` the second is not told.
    """
    own = ["id", "stable_key", "path", "graphql_key"]
    a = pairs.select(*own, F.explode(left).alias("f")).select(*own, F.col("f.name").alias("name"), F.col("f.type").alias("ta"), F.coalesce("f.required", F.lit(False)).alias("ra"))
    b = pairs.select(*own, F.explode(right).alias("f")).select(*own, F.col("f.name").alias("name"), F.col("f.type").alias("tb"), F.coalesce("f.required", F.lit(False)).alias("rb"))
    both = a.join(b, [*own, "name"], "full_outer")
    what = F.when(F.col("rb").isNull(), "missing").when(F.col("ra").isNull(), F.lit("extra") if extras else F.lit(None).cast("string")).when(type_family(F.col("ta")) != type_family(F.col("tb")), "type").when(F.col("ra") != F.col("rb"), "required")
    return both.select("id", "stable_key", "path", "graphql_key", F.concat_ws(" ", what, "name").alias("detail"), what.alias("what")).where("what is not null").drop("what")


def response_field_drift(g: KnowledgeGraph) -> DataFrame:
    p = endpoint_pairs(g)
    names = lambda c, f: F.transform(fields_of(c, f), lambda x: x["name"])
    a = p.select("id", "stable_key", "path", "graphql_key", names("rest", "response_fields").alias("a"), names("graphql", "response_fields").alias("b")).where("size(a) > 0 and size(b) > 0")
    d = a.withColumn("detail", F.concat_ws(",", F.array_sort(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))))).where("detail <> ''")
    return emit(d.select("id", "stable_key", "path", "detail"), "api_response_schema_mismatch", "medium", "checker-api", "response fields differ", scope="parity")


def request_drift(g: KnowledgeGraph, name: str = "request_fields", scope: str = "request") -> DataFrame:
    found = shape_mismatches(endpoint_pairs(g), fields_of("rest", name), fields_of("graphql", name))
    return emit(found, "api_request_schema_mismatch", "medium", "checker-api", "request fields differ", scope=scope)


def parameter_drift(g: KnowledgeGraph) -> DataFrame:
    """Path, query and header parameters against variables; what GraphQL has besides is not told. Path parameters are always required."""
    rest = F.transform(F.coalesce(F.from_json(F.get_json_object("rest", "$.parameters"), "array<struct<name:string,`in`:string,type:string,required:boolean>>"), F.array().cast("array<struct<name:string,`in`:string,type:string,required:boolean>>")), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), (F.coalesce(x["required"], F.lit(False)) | (x["in"] == "path")).alias("required")))
    var = F.transform(F.coalesce(F.from_json(F.get_json_object("graphql", "$.variable_definitions"), "array<struct<name:string,type:string>>"), F.array().cast("array<struct<name:string,type:string>>")), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.coalesce(x["type"].endswith("!"), F.lit(False)).alias("required")))
    return emit(shape_mismatches(endpoint_pairs(g), rest, var, extras=False), "api_request_schema_mismatch", "medium", "checker-api", "parameters differ", scope="parameters")


def response_schema_drift(g: KnowledgeGraph) -> DataFrame:
    """REST response fields against the selection root that fits best: fewest mismatches, then name; a root that fits is no finding.

    The GraphQL payload's ``response_roots`` are (root, fields).
    """
    roots = F.from_json(F.get_json_object("graphql", "$.response_roots"), f"array<struct<root:string,fields:{FIELDS}>>")
    p = endpoint_pairs(g).withColumn("left", fields_of("rest", "response_fields")).where("size(left) > 0").withColumn("r", F.explode(roots))
    tagged = p.withColumn("graphql_key", F.concat_ws("\0", "graphql_key", "r.root"))
    found = shape_mismatches(tagged, F.col("left"), F.col("r.fields"))
    counted = tagged.select("id", "stable_key", "path", "graphql_key").join(found.groupBy("id", "graphql_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("detail")), ",").alias("detail")), ["id", "graphql_key"], "left")
    best = counted.groupBy("id", "stable_key", "path").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "graphql_key", "detail")).alias("m"))
    return emit(best.where("m.n > 0").select("id", "stable_key", "path", F.col("m.detail").alias("detail")), "api_response_schema_mismatch", "medium", "checker-api", "response schema differs", scope="schema")


def status_drift(g: KnowledgeGraph) -> DataFrame:
    """Documented statuses without a success, or without 401 or 403 where authentication is required."""
    p = endpoint_pairs(g).withColumn("s", strings("responses", "rest")).where("size(s) > 0")
    of = F.lower(F.coalesce(F.get_json_object("graphql", "$.operation_type"), F.lit("query")))
    good = F.when(of == "mutation", F.array(*map(F.lit, ("200", "201", "202", "204", "2XX", "default")))).when(of == "subscription", F.array(*map(F.lit, ("101", "200", "2XX", "default")))).otherwise(F.array(*map(F.lit, ("200", "206", "2XX", "default"))))
    needed = F.filter(F.array(F.lit("401"), F.lit("403")), lambda c: ~F.array_contains("s", c) & ~F.arrays_overlap("s", F.array(F.lit("4XX"), F.lit("default"))))
    auth = F.coalesce(F.get_json_object("rest", "$.authentication_required") == "true", F.lit(False))
    lacks = F.concat(F.when(~F.arrays_overlap("s", good), F.array(F.lit("success"))).otherwise(F.array().cast(NONE)), F.when(auth, needed).otherwise(F.array().cast(NONE)))
    found = p.select("id", "stable_key", "path", F.explode(lacks).alias("detail"))
    return emit(found.distinct(), "api_status_code_undocumented", "low", "checker-api", "status is not documented")


REQUIREMENT = "struct<required:boolean,families:array<string>,permissions:array<string>>"
ALTERNATIVES = "array<struct<families:array<string>,permissions:array<string>>>"
#: GraphQL directives that ask for authentication and for permissions, unless a configuration maps others.
DIRECTIVES = {"auth": ("auth", "authenticated", "requiresAuth", "isAuthenticated"), "permission": ("hasRole", "hasPermission", "requiresScopes", "permission")}


def directive_requirements(g: KnowledgeGraph, mapping: DataFrame | None = None) -> DataFrame:
    """(stable_key, required, families, permissions) of GraphQL operations by their directives.

    ``mapping`` (operation, directive, family, permission) adds to or, for an operation, replaces the default words.
    """
    spark = g.entities.sparkSession
    words = [(None, d, "bearer", None) for d in DIRECTIVES["auth"]] + [(None, d, "bearer", "*") for d in DIRECTIVES["permission"]]
    table = spark.createDataFrame(words, "operation string, directive string, family string, permission string")
    if mapping is not None:
        table = mapping.select("operation", "directive", "family", "permission").unionByName(table)
    ops = of_kind(g, "api_endpoint").where(field("protocol") == "graphql").select("stable_key", field("operation_name").alias("name"), F.explode_outer(F.from_json(field("directive_applications"), "array<struct<name:string,arguments:array<string>>>")).alias("d"))
    met = ops.join(F.broadcast(table), (F.col("d.name") == F.col("directive")) & (F.col("operation").isNull() | (F.col("operation") == F.col("name"))), "left")
    own = Window.partitionBy("stable_key", "d.name")
    met = met.withColumn("specific", F.max(F.col("operation").isNotNull().cast("int")).over(own)).where((F.col("specific") == 0) | F.col("operation").isNotNull() | F.col("directive").isNull())
    permissions = F.when(F.col("permission") == "*", F.coalesce("d.arguments", F.array().cast(NONE))).when(F.col("permission").isNotNull(), F.array("permission")).otherwise(F.array().cast(NONE))
    return met.groupBy("stable_key").agg((F.count("directive") > 0).alias("required"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(permissions)))).alias("permissions"))


def _security(g: KnowledgeGraph, mapping: DataFrame | None) -> DataFrame:
    q = directive_requirements(g, mapping).select(F.col("stable_key").alias("graphql_key"), "required", "families", "permissions")
    alternatives = F.coalesce(F.from_json(F.get_json_object("rest", "$.security_requirements"), ALTERNATIVES), F.array().cast(ALTERNATIVES))
    rest_required = F.coalesce(F.get_json_object("rest", "$.authentication_required") == "true", F.lit(False))
    return endpoint_pairs(g).join(q, "graphql_key").withColumns({"alternatives": alternatives, "rest_required": rest_required})


def authentication_drift(g: KnowledgeGraph, mapping: DataFrame | None = None) -> DataFrame:
    p = _security(g, mapping)
    fits = F.exists("alternatives", lambda a: F.size(F.array_except(F.coalesce(a["families"], F.array().cast(NONE)), F.col("families"))) == 0)
    what = F.when(F.col("rest_required") != F.col("required"), "required").when(F.col("required") & (F.size("alternatives") > 0) & ~fits, "family")
    return emit(p.select("id", "stable_key", "path", what.alias("detail")).where("detail is not null"), "api_auth_requirement_mismatch", "high", "checker-api", "authentication differs")


def permission_drift(g: KnowledgeGraph, mapping: DataFrame | None = None) -> DataFrame:
    """Where both sides require authentication: the compatible alternative (else any) whose permissions are closest, if it is not equal."""
    p = _security(g, mapping).where("required and rest_required")
    each = p.select("id", "stable_key", "path", "families", F.col("permissions").alias("want"), F.posexplode("alternatives").alias("n", "a"))
    off = F.size(F.array_except(F.coalesce("a.families", F.array().cast(NONE)), F.col("families"))).cast("boolean")
    have = F.coalesce("a.permissions", F.array().cast(NONE))
    less, more = F.array_except("want", have), F.array_except(have, F.col("want"))
    best = each.groupBy("id", "stable_key", "path").agg(F.min(F.struct(off.alias("off"), (F.size(less) + F.size(more)).alias("far"), "n", F.concat_ws(",", F.array_sort(F.concat(less, more))).alias("detail"))).alias("m"))
    return emit(best.where("m.far > 0").select("id", "stable_key", "path", F.col("m.detail").alias("detail")), "api_permission_mismatch", "high", "checker-api", "permissions differ")


# --- operations


def undocumented(g: KnowledgeGraph, scope: str) -> DataFrame:
    """Environment variables (one for each key), configuration keys, scripts or deployments without a document."""
    e = {
        "env": lambda: of_kind(g, "env_var"),
        "config": lambda: of_kind(g, "feature").where(field("feature_kind") == "runtime_config_key"),
        "scripts": lambda: of_kind(g, "script", "script_command"),
        "deployment": lambda: of_kind(g, "docker_service", "ci_job"),
    }[scope]().dropDuplicates(["stable_key"])
    return emit(subject(missing(e, g.relations, "dst", *DOCUMENTS)), "missing_documentation", "low", "checker-operations", f"{scope}: nothing documents this", scope=scope)


def _targets(g: KnowledgeGraph) -> DataFrame:
    r = of_kind(g, "runbook").select("id", "stable_key", F.col("source.path").alias("path"), F.explode(F.array_distinct(strings("targets"))).alias("key"))
    have = of_kind(g, *TARGETS).select(F.col("stable_key").alias("key"), F.lower("name").alias("term"))
    return r.join(have, "key", "left")


def runbook_findings(g: KnowledgeGraph) -> DataFrame:
    """Runbooks without an operational target, without steps, with steps that mention no target, or not all."""
    books = of_kind(g, "runbook")
    t = _targets(g).where("term is not null")
    a = emit(subject(books.join(t.select("id").distinct(), "id", "left_anti")), "missing_documentation", "medium", "checker-operations", "runbook has no operational target", scope="runbooks")
    steps = g.relations.where("kind = 'contains'").select(F.col("src").alias("id"), F.col("dst").alias("step")).join(of_kind(g, "operation_step").select(F.col("id").alias("step"), F.lower(F.concat_ws(" ", "name", "title", field("text"))).alias("text")), "step")
    with_steps = steps.select("id").distinct()
    b = emit(subject(books.join(with_steps, "id", "left_anti")), "missing_documentation", "medium", "checker-operations", "runbook has no step", scope="runbook_steps")
    met = t.join(steps, "id").groupBy("id", "stable_key", "path", "key").agg(F.bool_or(F.contains("text", F.col("term"))).alias("met"))
    n = met.groupBy("id", "stable_key", "path").agg(F.count_if("met").alias("n"), F.count("*").alias("all"))
    null = F.lit(None).cast("string").alias("detail")
    c = emit(n.where("n = 0").select("id", "stable_key", "path", null), "stale_documentation", "medium", "checker-operations", "no step mentions a target", scope="runbooks")
    part = met.where("not met").join(n.where("n > 0 and n < all").select("id"), "id", "left_semi").groupBy("id", "stable_key", "path").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("detail"))
    d = emit(part, "stale_documentation", "low", "checker-operations", "steps do not mention every target", scope="runbooks")
    return a.unionByName(b).unionByName(c).unionByName(d)


# --- GraphQL documents


def graphql_findings(g: KnowledgeGraph) -> DataFrame:
    """Spreads without a fragment, conditions without a type, variables that are undeclared, unused or of no known type."""
    ops = of_kind(g, "api_endpoint").where(field("protocol") == "graphql")
    fragments, schemas = of_kind(g, "graphql_fragment"), of_kind(g, "api_schema").where(field("protocol") == "graphql")
    base = lambda df, key: df.select("id", "stable_key", F.col("source.path").alias("path"), F.explode(F.array_distinct(key)).alias("key"), field("operation_name").alias("op")).withColumn("detail", F.col("key"))
    out = emit(unresolved(base(ops.unionByName(fragments), strings("fragment_spreads")), fragments.select(F.col("name").alias("key"))), "graphql_fragment_unresolved", "high", "extractor-graphql", "fragment is unknown", open_kind=True)
    types = schemas.select(F.col("name").alias("key"))
    some = types.limit(1).select(F.lit(True).alias("some"))  # without any schema nothing can be told of types
    told = lambda df: df.join(F.broadcast(some)).drop("some")
    cond = F.concat(strings("inline_type_conditions"), F.array_compact(F.array(field("type_condition"))))
    out = out.unionByName(emit(told(unresolved(base(ops.unionByName(fragments), cond), types)), "graphql_type_condition_unresolved", "high", "extractor-graphql", "type is unknown", open_kind=True))
    defined = F.coalesce(F.from_json(field("variable_definitions"), "array<struct<name:string,type:string>>"), F.array().cast("array<struct<name:string,type:string>>"))
    names = F.transform(defined, lambda d: d["name"])
    out = out.unionByName(emit(base(ops, F.array_except(strings("variables"), names)), "graphql_variable_undeclared", "high", "extractor-graphql", "variable is not declared", open_kind=True))
    out = out.unionByName(emit(base(ops, F.array_except(names, strings("variables"))), "graphql_variable_unused", "low", "extractor-graphql", "variable is not used", open_kind=True))
    builtin = F.array(*map(F.lit, ("Int", "Float", "String", "Boolean", "ID")))
    kinds = F.array_except(F.transform(defined, lambda d: named_type(d["type"])), builtin)
    return out.unionByName(emit(told(unresolved(base(ops, kinds), types)), "graphql_variable_type_unresolved", "medium", "extractor-graphql", "variable's type is unknown", open_kind=True))


# --- surfaces, contracts, page builder


def surface_findings(g: KnowledgeGraph) -> DataFrame:
    """Rules on surfaces by the markers that facts of kind ``ffa_layer_marker`` hold: {"module", "surface", "role", "marker"}."""
    f = g.facts.where("kind_other = 'ffa_layer_marker'").select(*(F.get_json_object("value", f"$.{x}").alias(x) for x in ("module", "surface", "role", "marker")))
    has = lambda role, marker=None: F.bool_or((F.col("role") == role) & (F.lit(True) if marker is None else F.coalesce(F.col("marker") == marker, F.lit(False))))
    s = f.groupBy("module", "surface").agg(
        has("core").alias("core"), has("transport").alias("transport"), has("ui").alias("ui"), has("host").alias("host"),
        has("core", "imports_ui").alias("core_ui"), has("ui", "raw_transport").alias("ui_raw"), has("host", "owns_ui").alias("host_ui"), has("transport", "profile").alias("profile"),
    )
    rules = [
        ("core_depends_on_ui", F.col("core_ui")), ("ui_raw_transport", F.col("ui_raw")), ("host_owns_ui", F.col("host_ui")), ("missing_core", ~F.col("core")), ("missing_transport", ~F.col("transport")),
        ("missing_ui", ~F.col("ui")), ("transport_profile_missing", F.col("transport") & ~F.col("profile")), ("forgotten_surface", ~F.col("core") & ~F.col("transport") & ~F.col("ui")),
    ]
    e = g.entities.select("id", "stable_key", F.col("source.path").alias("path"))
    rows = s.select(F.concat(F.lit("ffa_surface://"), "module", F.lit("/"), "surface").alias("stable_key"), "module", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("detail"))
    found = rows.join(e, "stable_key")
    out = None
    for name, _ in rules:
        d = emit(found.where(F.col("detail") == name).withColumn("detail", F.lit(None).cast("string")), f"ffa_{name}", "high" if "missing" in name else "medium", "adapter-ffa", name.replace("_", " "), open_kind=True)
        out = d if out is None else out.unionByName(d)
    return out


def surface_docs_drift(g: KnowledgeGraph) -> DataFrame:
    """Declared statuses (facts ``ffa_docs_status``: {"module", "surface", "shape"}) against the layers that are there, joined by +."""
    said = g.facts.where("kind_other = 'ffa_docs_status'").select(*(F.get_json_object("value", f"$.{x}").alias(x) for x in ("module", "surface", "shape")))
    seen = g.facts.where("kind_other = 'ffa_layer_marker'").select(F.get_json_object("value", "$.module").alias("module"), F.get_json_object("value", "$.surface").alias("surface"), F.get_json_object("value", "$.role").alias("role")).groupBy("module", "surface").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("seen"))
    off = said.join(seen, ["module", "surface"], "left").where(~F.col("shape").eqNullSafe(F.col("seen")))
    rows = off.select(F.concat(F.lit("ffa_surface://"), "module", F.lit("/"), "surface").alias("stable_key"), "module", F.concat_ws(" ", "shape", F.coalesce("seen", F.lit("none"))).alias("detail"))
    return emit(rows.join(g.entities.select("id", "stable_key", F.col("source.path").alias("path")), "stable_key"), "ffa_docs_drift", "low", "adapter-ffa", "declared shape differs", open_kind=True)


def contract_findings(g: KnowledgeGraph) -> DataFrame:
    """Rules on registries: a module's payload lists ``ports`` with name, trait, operations, context, error, policy, idempotency; facts
    ``fba_port_code`` hold the {"module", "port", "operations"} that code has."""
    port = "struct<name:string,trait:string,operations:array<struct<name:string,write:boolean,idempotent:boolean>>,context:string,error:string,policy:string>"
    m = g.entities.where(F.col("stable_key").startswith("fba_module://")).select("id", "stable_key", F.col("source.path").alias("path"), F.regexp_replace("stable_key", "^fba_module://", "").alias("module"), F.coalesce(F.from_json(field("ports"), f"array<{port}>"), F.array().cast(f"array<{port}>")).alias("ports"), strings("evidence").alias("ev"), field("tests_locked").alias("locked"), field("role").alias("role"))
    code = g.facts.where("kind_other = 'fba_port_code'").select(F.get_json_object("value", "$.module").alias("module"), F.get_json_object("value", "$.port").alias("port"), F.coalesce(F.from_json(F.get_json_object("value", "$.operations"), NONE), F.array().cast(NONE)).alias("code_ops"))
    null = F.lit(None).cast("string")
    def found(df, name, detail=null, severity="medium"):
        return emit(df.select("id", "stable_key", "path", "module", detail.alias("detail")), f"fba_{name}", severity, "adapter-fba", name.replace("_", " "), open_kind=True)
    rows = [
        found(m.where((F.col("role") == "provider") & (F.size("ports") == 0)), "provider_without_ports", severity="high"),
        found(m.where(F.size("ev") == 0), "evidence_missing"),
        found(m.where(~F.coalesce(F.col("locked") == "true", F.lit(False))), "tests_not_locked"),
    ]
    p = m.select("id", "stable_key", "path", "module", F.explode("ports").alias("p")).join(code.withColumnRenamed("port", "code_port"), (F.col("p.trait") == F.col("code_port")) & (m["module"] == code["module"]), "left").drop(code["module"])
    rows.append(found(p.where("code_port is null"), "port_trait_missing", F.col("p.name"), "high"))
    bare = g.facts.where("kind_other = 'fba_port_code'").select(F.col("subject").alias("id"), F.get_json_object("value", "$.module").alias("module"), F.get("evidence.source_file", F.lit(0)).alias("path"))
    bare = bare.where("module is not null").join(m.select("module"), "module", "left_anti").groupBy("id", "module").agg(F.min("path").alias("path"))
    rows.append(found(bare.withColumn("stable_key", F.concat(F.lit("fba_module://"), "module")), "code_without_registry"))
    live = p.where("code_port is not null")
    ops = F.transform(F.coalesce("p.operations", F.array().cast("array<struct<name:string,write:boolean,idempotent:boolean>>")), lambda o: o["name"])
    gone = live.withColumn("op", F.explode(F.array_except(ops, F.col("code_ops"))))
    rows.append(found(gone, "port_operation_missing", F.concat_ws("/", "p.name", "op"), "high"))
    for name in ("context", "error", "policy"):
        rows.append(found(live.where(F.col(f"p.{name}").isNull()), f"port_{name}_missing", F.col("p.name")))
    unsure = live.withColumn("op", F.explode("p.operations")).where(F.coalesce("op.write", F.lit(False)) & ~F.coalesce("op.idempotent", F.lit(False)))
    rows.append(found(unsure, "operation_idempotency_unasserted", F.concat_ws("/", "p.name", "op.name")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def dependency_findings(g: KnowledgeGraph) -> DataFrame:
    """Dependencies against their providers: unknown provider, contract, port, profile, consumer, fallback or degraded mode that differ.

    Both payloads have these fields; a field the consumer leaves out is not compared.
    """
    parts = F.split(F.regexp_replace("stable_key", r"^[a-z_]+://", ""), "/")
    d = g.entities.where(F.col("stable_key").startswith("fba_dependency://")).select("id", "stable_key", F.col("source.path").alias("path"), parts[0].alias("consumer"), parts[1].alias("module"), F.col("payload").alias("own"))
    prov = g.entities.where(F.col("stable_key").startswith("fba_module://")).select(F.regexp_replace("stable_key", "^fba_module://", "").alias("module"), F.col("payload").alias("theirs"))
    both = d.join(prov, "module", "left")
    rows = [emit(both.where("theirs is null").select("id", "stable_key", "path", "module", F.lit(None).cast("string").alias("detail")), "fba_provider_unresolved", "high", "adapter-fba", "provider is unknown", open_kind=True)]
    for name, listed in (("contract", False), ("port", True), ("profile", True), ("consumer", True), ("fallback", False), ("degraded", False)):
        a = F.get_json_object("own", f"$.{name}") if name != "consumer" else F.col("consumer")
        b = F.get_json_object("theirs", f"$.{name}s" if listed else f"$.{name}")
        off = ~F.array_contains(F.coalesce(F.from_json(b, NONE), F.array().cast(NONE)), a) if listed else ~a.eqNullSafe(b)
        rows.append(emit(both.where(F.col("theirs").isNotNull() & a.isNotNull() & off & (b.isNotNull() if name == "consumer" else F.lit(True))).select("id", "stable_key", "path", "module", a.alias("detail")), f"fba_{name}_mismatch", "medium", "adapter-fba", f"{name} differs", open_kind=True))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def contract_docs_drift(g: KnowledgeGraph) -> DataFrame:
    """Statuses that documents declare (facts ``fba_docs_status``: {"module", "status"}) against the registry's."""
    said = g.facts.where("kind_other = 'fba_docs_status'").select(F.get_json_object("value", "$.module").alias("module"), F.get_json_object("value", "$.status").alias("said"))
    m = g.entities.where(F.col("stable_key").startswith("fba_module://")).select("id", "stable_key", F.col("source.path").alias("path"), F.regexp_replace("stable_key", "^fba_module://", "").alias("module"), field("status").alias("real"))
    return emit(said.join(m, "module").where(~F.col("said").eqNullSafe(F.col("real"))).select("id", "stable_key", "path", "module", F.concat_ws(" ", "said", "real").alias("detail")), "fba_docs_drift", "low", "adapter-fba", "declared status differs", open_kind=True)


SEAMS = ("render", "load", "save")


def page_builder_findings(g: KnowledgeGraph) -> DataFrame:
    """Consumers against the registry: with no provider at all only that is told; an unregistered consumer gets no other finding.

    Capabilities and profiles must be equal as sets (a consumer may leave them empty), required seams be there, waves have fresh evidence.
    """
    provider = g.entities.where(F.col("kind_other") == "page_builder_provider").select(F.col("stable_key").alias("provider"), F.col("payload").alias("theirs"))
    c = g.entities.where(F.col("kind_other") == "page_builder_consumer").select("id", "stable_key", F.col("source.path").alias("path"), "payload", field("provider").alias("provider"))
    any_provider = provider.select(F.lit(True).alias("any")).limit(1)
    c = c.join(F.broadcast(any_provider), how="left")
    null = F.lit(None).cast("string")
    def found(df, name, detail=null, severity="medium"):
        return emit(df.select("id", "stable_key", "path", detail.alias("detail")), f"page_builder_{name}", severity, "adapter-page-builder", name.replace("_", " "), open_kind=True)
    out = found(c.where("any is null"), "registry_missing", severity="high")
    both = c.where("any").join(provider, "provider", "left")
    listed = F.array_contains(F.coalesce(F.from_json(F.get_json_object("theirs", "$.consumers"), NONE), F.array().cast(NONE)), F.col("stable_key"))
    out = out.unionByName(found(both.where(F.col("theirs").isNull() | ~listed), "consumer_unregistered", severity="high"))
    live = both.where(F.col("theirs").isNotNull() & listed)
    for name in ("contract", "version", "content_format"):
        a, b = field(name), F.get_json_object("theirs", f"$.{name}")
        out = out.unionByName(found(live.where(~a.eqNullSafe(b)), f"{name}_mismatch", F.concat_ws(" ", a, b)))
    for name in ("capabilities", "profiles"):
        a, b = strings(name), strings(name, "theirs")
        off = F.concat_ws(",", F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a))))
        out = out.unionByName(found(live.where((F.size(a) > 0) & (off != "")), f"{name}_mismatch", off))
    gone = F.array_except(F.array(*map(F.lit, SEAMS)), strings("seams"))
    out = out.unionByName(found(live.withColumn("seam", F.explode(gone)), "seam_missing", F.col("seam"), "high"))
    waves = live.withColumn("w", F.explode(F.coalesce(F.from_json(field("wave_evidence"), "array<struct<name:string,evidence:string,fresh:boolean>>"), F.array().cast("array<struct<name:string,evidence:string,fresh:boolean>>"))))
    out = out.unionByName(found(waves.where("w.evidence is null"), "wave_evidence_missing", F.col("w.name")))
    return out.unionByName(found(waves.where("w.evidence is not null and not coalesce(w.fresh, false)"), "wave_evidence_stale", F.col("w.name"), "low"))


CHECKERS: dict[str, list[Callable[[KnowledgeGraph], DataFrame]]] = {
    "checker-markdown": [page_without_title, empty_page, unresolved_reference, ambiguous_reference, duplicate_document],
    "checker-api": [
        not_implemented, not_documented, lambda g: schema_unresolved(g, "request"), lambda g: schema_unresolved(g, "response"), invalid_examples,
        response_field_drift, request_drift, lambda g: request_drift(g, "external_request_fields", "external_request"), parameter_drift, response_schema_drift, status_drift, authentication_drift, permission_drift,
    ],
    "checker-operations": [*((lambda g, s=s: undocumented(g, s)) for s in ("env", "config", "scripts", "deployment")), runbook_findings],
    "extractor-graphql": [graphql_findings],
    "adapter-ffa": [surface_findings, surface_docs_drift],
    "adapter-fba": [contract_findings, dependency_findings, contract_docs_drift],
    "adapter-page-builder": [page_builder_findings],
}


def gated(diagnostics: DataFrame, affected: DataFrame) -> DataFrame:
    """Diagnostics that name an affected entity (id)."""
    own = diagnostics.select("id", F.explode("entities").alias("e")).join(affected.select(F.col("id").alias("e")), "e", "left_semi").select("id").distinct()
    return diagnostics.join(own, "id", "left_semi")


def rule_rows(g: KnowledgeGraph, checkers: dict[str, list[Callable[[KnowledgeGraph], DataFrame]]]) -> DataFrame | None:
    """Unfinished rows of all rules; None without any."""
    out = None
    for rule in (r for rules in checkers.values() for r in rules):
        rows = rule(g)
        out = rows if out is None else out.unionByName(rows)
    return out


def check(g: KnowledgeGraph, checkers: tuple[str, ...] = tuple(CHECKERS), affected: DataFrame | None = None) -> DataFrame:
    """All diagnostics that the checkers derive, each id once; with ``affected`` (id), those that name an affected entity."""
    rows = rule_rows(g, {name: CHECKERS[name] for name in checkers})
    if rows is None:
        return g.diagnostics.limit(0)
    out = finished(rows)
    return out if affected is None else gated(out, affected)
