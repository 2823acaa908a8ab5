"""OpenAPI 3 contracts, JSON or YAML: endpoints, schemas, examples and parameters."""

from __future__ import annotations

import json

import yaml

from graphloom.sources.extract import Extractor, Out, Source, dumped, file_id, fnv

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


class _Loader(yaml.SafeLoader):
    """Dates stay texts: a contract means what it writes."""


_Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        try:
            return yaml.load(text, _Loader)
        except yaml.YAMLError:
            return None


def supports(src: Source) -> bool:
    return src.hint in ("json", "yaml") and "openapi" in src.text


def references(node) -> list[str]:
    """Every ``$ref`` below a node, in order, each once."""
    out: list[str] = []
    if isinstance(node, dict):
        if isinstance(node.get("$ref"), str):
            out.append(node["$ref"])
        for v in node.values():
            out += references(v)
    elif isinstance(node, list):
        for v in node:
            out += references(v)
    return list(dict.fromkeys(out))


def resolved(node, doc: dict, seen: tuple[str, ...] = ()):
    """What a local reference means; other nodes as they are."""
    while isinstance(node, dict) and isinstance(node.get("$ref"), str):
        ref = node["$ref"]
        if not ref.startswith("#/") or ref in seen:
            return node
        seen, at = (*seen, ref), doc
        for part in ref[2:].split("/"):
            at = at.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
        if at is None:
            return node
        node = at
    return node


def fields(schema, doc: dict) -> list[dict]:
    """(name, type, required) of a schema's properties; arrays tell their items'."""
    s = resolved(schema, doc)
    if not isinstance(s, dict):
        return []
    if s.get("type") == "array":
        return fields(s.get("items"), doc)
    props, required = dict(s.get("properties") or {}), set(s.get("required") or [])
    for part in s.get("allOf") or []:
        p = resolved(part, doc)
        if isinstance(p, dict):
            props |= p.get("properties") or {}
            required |= set(p.get("required") or [])
    return [{"name": k, "type": type_of(v, doc), "required": k in required} for k, v in sorted(props.items())]


def type_of(schema, doc: dict) -> str:
    if isinstance(schema, dict) and isinstance(schema.get("$ref"), str):
        return schema["$ref"].rsplit("/", 1)[-1]
    s = schema if isinstance(schema, dict) else {}
    kind = s.get("type")
    kind = next((k for k in kind if k != "null"), None) if isinstance(kind, list) else kind
    return f"[{type_of(s.get('items'), doc)}]" if kind == "array" else str(kind or "object")


def parameters(path_item: dict, op: dict, doc: dict) -> list[dict]:
    """Parameters of the path, replaced by the operation's of the same name and place."""
    out: dict[tuple, dict] = {}
    for p in [*(path_item.get("parameters") or []), *(op.get("parameters") or [])]:
        ref, p = (p.get("$ref") if isinstance(p, dict) else None), resolved(p, doc)
        if isinstance(p, dict) and "name" in p:
            out[p["name"], p.get("in")] = {"name": p["name"], "in": p.get("in"), "required": bool(p.get("required")) or p.get("in") == "path", "type": type_of(p.get("schema") or p, doc), "reference": ref}
    return [out[k] for k in sorted(out, key=str)]


def security(op: dict, doc: dict) -> tuple[list[dict], bool]:
    """Alternatives as (families, permissions), and whether one of them is needed: an empty alternative makes it optional."""
    rules = op.get("security") if op.get("security") is not None else doc.get("security")
    schemes = (doc.get("components") or {}).get("securitySchemes") or {}
    out = []
    for rule in rules or []:
        names = sorted(rule or {})
        kinds = [schemes.get(n) or {} for n in names]
        family = [("bearer" if s.get("type") in ("oauth2", "openIdConnect") else s.get("scheme") or s.get("type") or n) for n, s in zip(names, kinds, strict=True)]
        out.append({"families": sorted({str(f).lower() for f in family}), "permissions": sorted({p for n in names for p in rule[n] or []})})
    return out, bool(out) and all(a["families"] for a in out)


def examples(src: Source, out: Out, key: str, side: str, media: dict, doc: dict, status: str | None) -> None:
    components = (doc.get("components") or {}).get("schemas") or {}
    for kind, m in sorted((media or {}).items()):
        if not isinstance(m, dict):
            continue
        many = {"default": m["example"]} if "example" in m else {}
        many |= {n: (resolved(e, doc) or {}).get("value") for n, e in (m.get("examples") or {}).items() if isinstance(resolved(e, doc), dict) and "value" in resolved(e, doc)}
        for name, value in sorted(many.items()):
            ident = fnv("\0".join((key, side, status or "", kind, name)))
            payload = {"endpoint": key, "side": side, "status": status, "media_type": kind, "value": value}
            if "schema" in m:
                payload |= {"schema": m["schema"], "schemas": components}
            out.entity("api_example", f"api-example://{src.path}#{ident}", name, 1, language="openapi", payload=payload)


def extract(src: Source, out: Out) -> None:
    doc = load(src.text)
    if not isinstance(doc, dict) or not str(doc.get("openapi", "")).startswith("3."):
        return
    file = file_id(src.path)
    for path, item in (doc.get("paths") or {}).items():
        item = resolved(item, doc)
        for method in METHODS:
            op = item.get(method) if isinstance(item, dict) else None
            if not isinstance(op, dict):
                continue
            key = f"api://{method.upper()}:{path}"
            body = resolved(op.get("requestBody") or {}, doc)
            responses = {str(s): resolved(r, doc) for s, r in (op.get("responses") or {}).items()}
            alternatives, needed = security(op, doc)
            media = lambda x: (x or {}).get("content") or {} if isinstance(x, dict) else {}
            good = next((r for s, r in sorted(responses.items()) if s.startswith("2")), next(iter(responses.values()), None))
            shape = lambda x: next((fields(m.get("schema"), doc) for _, m in sorted(media(x).items()) if isinstance(m, dict)), [])
            name = op.get("operationId")
            i = out.entity(
                "api_endpoint", key, f"{method.upper()} {path}", 1, language="openapi", title=op.get("summary"), aliases=[name] if name else [],
                payload={
                    "protocol": "rest", "openapi_version": doc["openapi"], "method": method.upper(), "path": path, "operation_id": name, "summary": op.get("summary"), "description": op.get("description"),
                    "tags": op.get("tags") or [], "deprecated": bool(op.get("deprecated")), "parameters": parameters(item, op, doc), "has_request_body": "requestBody" in op, "request_schemas": references([m.get("schema") for m in media(body).values()]),
                    "responses": sorted(responses), "response_schemas": list(dict.fromkeys(x for r in responses.values() for x in references([m.get("schema") for m in media(r).values() if isinstance(m, dict)]))),
                    "security_requirements": alternatives, "authentication_required": needed, "request_fields": shape(body), "response_fields": shape(good),
                },
            )
            out.fact("route_declared", i, {"method": method.upper(), "path": path, "operation_id": name}, 1, object=file)
            examples(src, out, key, "request", media(body), doc, None)
            for status, r in sorted(responses.items()):
                examples(src, out, key, "response", media(r), doc, status)
    components = doc.get("components") or {}
    for name, schema in sorted((components.get("schemas") or {}).items()):
        key = f"api-schema://{src.path}#{name}"
        i = out.entity("api_schema", key, name, 1, language="openapi", title=schema.get("title") if isinstance(schema, dict) else None, payload={"schema": schema, "reference": f"#/components/schemas/{name}", "references": references(schema)})
        out.fact("symbol_defined", i, {"stable_key": key, "path": src.path, "schema_kind": "component"}, 1, object=file)
    for name, p in sorted((components.get("parameters") or {}).items()):
        out.entity("other", f"api-parameter://{src.path}#{name}", name, 1, language="openapi", payload={"parameter": dumped(p)}, other="api_parameter")


EXTRACTORS = [Extractor("openapi", supports, extract)]
