"""GraphQL documents and introspection results: operations, types, fragments and directives."""

from __future__ import annotations

import json
import re

from graphloom.sources.extract import Extractor, Out, Source, file_id

TOKEN = re.compile(r'"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|#[^\n]*|\.\.\.|[A-Za-z_]\w*|-?\d[\w.+-]*|[^\s,]')
TYPES = ("type", "interface", "input", "enum", "union", "scalar")


class Cursor:
    """Tokens of a document with their lines."""

    def __init__(self, text: str) -> None:
        self.toks, line, at = [], 1, 0
        for m in TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m[0][0] != "#":
                self.toks.append((m[0], line))
        self.at = 0

    @property
    def peek(self) -> str:
        return self.toks[self.at][0] if self.at < len(self.toks) else ""

    @property
    def line(self) -> int:
        return self.toks[min(self.at, len(self.toks) - 1)][1] if self.toks else 1

    def next(self) -> str:
        t = self.peek
        self.at += 1
        return t

    def take(self, t: str) -> bool:
        if self.peek == t:
            self.at += 1
            return True
        return False

    def inside(self, open_: str, close: str) -> list[str]:
        """Tokens between brackets, which may nest; the cursor goes past them."""
        out, depth = [], 0
        while self.peek:
            t = self.next()
            depth += (t == open_) - (t == close)
            if depth == 0:
                break
            if not (t == open_ and depth == 1):
                out.append(t)
        return out

    def type(self) -> str:
        t = ""
        if self.take("["):
            t = f"[{self.type()}]"
            self.take("]")
        else:
            t = self.next()
        return t + "!" if self.take("!") else t

    def directives(self) -> list[dict]:
        out = []
        while self.take("@"):
            name, args = self.next(), []
            if self.peek == "(":
                args = [t.strip('"') for t in self.inside("(", ")") if t.startswith('"')]
            out.append({"name": name, "arguments": args})
        return out


def selection(c: Cursor) -> dict:
    """Roots, spreads, type conditions, arguments, variables and directives of a selection set."""
    out: dict[str, list] = {"roots": [], "spreads": [], "conditions": [], "arguments": [], "variables": [], "directives": []}
    depth = 0
    while c.peek:
        t = c.next()
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if depth == 0:
                break
        elif t == "...":
            if c.take("on"):
                out["conditions"].append(c.next())
            elif c.peek not in ("{", "@"):
                out["spreads"].append(c.next())
        elif t == "@":
            out["directives"].append(c.next())
        elif t == "(":
            c.at -= 1
            args = c.inside("(", ")")
            out["arguments"] += [a for a, b in zip(args, args[1:], strict=False) if b == ":" and re.match(r"[A-Za-z_]", a)]
            out["variables"] += [b for a, b in zip(args, args[1:], strict=False) if a == "$"]
        elif re.match(r"[A-Za-z_]", t):
            if c.take(":"):
                t = c.next()
            if depth == 1:
                out["roots"].append(t)
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def operation(c: Cursor, src: Source, out: Out, kind: str, line: int) -> None:
    name = c.next() if re.match(r"[A-Za-z_]", c.peek) else "anonymous"
    defined = []
    if c.take("("):
        while c.peek and not c.take(")"):
            if c.take("$"):
                var = c.next()
                c.take(":")
                defined.append({"name": var, "type": c.type()})
            else:
                c.next()
    applied = c.directives()
    s = selection(c)
    key = f"api://GRAPHQL_{kind.upper()}:{name}"
    i = out.entity(
        "api_endpoint", key, f"{kind.upper()} {name}", line, language="graphql", aliases=[name],
        payload={"protocol": "graphql", "operation_type": kind, "operation_name": name, "variables": s["variables"], "variable_definitions": defined, "arguments": s["arguments"], "selection_roots": s["roots"], "fragment_spreads": s["spreads"], "inline_type_conditions": s["conditions"], "directives": sorted({d["name"] for d in applied} | set(s["directives"])), "directive_applications": applied},
    )
    out.fact("route_declared", i, {"operation_type": kind, "operation_name": name}, line, object=file_id(src.path))


def members(c: Cursor) -> list[dict]:
    """Fields or input values: name, type, arguments, directives, required."""
    out = []
    c.take("{")
    while c.peek and not c.take("}"):
        t = c.next()
        if not re.match(r"[A-Za-z_]", t):
            continue
        args = []
        if c.peek == "(":
            raw = c.inside("(", ")")
            args = [a for a, b in zip(raw, raw[1:], strict=False) if b == ":" and re.match(r"[A-Za-z_]", a)]
        kind = c.type() if c.take(":") else None
        if c.take("="):
            c.inside(c.peek, {"{": "}", "[": "]"}[c.peek]) if c.peek in "{[" else c.next()
        out.append({"name": t, "type": kind, "arguments": args, "directives": [d["name"] for d in c.directives()]})
    return out


def schema_type(c: Cursor, src: Source, out: Out, kind: str, line: int) -> None:
    name, rows = c.next(), []
    while c.peek in ("implements", "&") or (c.peek and c.toks[c.at - 1][0] in ("implements", "&")):
        c.next()
    applied = c.directives()
    if kind == "union" and c.take("="):
        c.take("|")
        rows.append({"name": c.next(), "type": None, "arguments": [], "directives": []})
        while c.take("|"):
            rows.append({"name": c.next(), "type": None, "arguments": [], "directives": []})
    elif c.peek == "{":
        rows = members(c)
    schema(src, out, kind, name, line, rows, [d["name"] for d in applied])


def schema(src: Source, out: Out, kind: str, name: str, line: int, rows: list[dict], directives: list[str]) -> None:
    key = f"api-schema://graphql:{src.path}#{name}"
    i = out.entity(
        "api_schema", key, name, line, language="graphql",
        payload={"protocol": "graphql", "schema_kind": kind, "fields": [r["name"] for r in rows], "field_arguments": sorted({a for r in rows for a in r["arguments"]}), "member_types": [{"name": r["name"], "type": r["type"]} for r in rows if r["type"]], "directives": directives, "deprecated_members": [r["name"] for r in rows if "deprecated" in r["directives"]]},
    )
    out.fact("symbol_defined", i, {"stable_key": key, "path": src.path, "schema_kind": kind}, line, object=file_id(src.path))


def extract(src: Source, out: Out) -> None:
    c = Cursor(src.text)
    while c.peek:
        line, t = c.line, c.next()
        if t == "{":
            c.at -= 1
            operation(c, src, out, "query", line)
        elif t in ("query", "mutation", "subscription"):
            operation(c, src, out, t, line)
        elif t == "fragment":
            name = c.next()
            condition = c.next() if c.take("on") else None
            applied = c.directives()
            s = selection(c)
            out.entity("other", f"api-fragment://graphql:{src.path}#{name}", name, line, language="graphql", payload={"protocol": "graphql", "type_condition": condition, "fragment_spreads": s["spreads"], "inline_type_conditions": s["conditions"], "selection_roots": s["roots"], "directives": [d["name"] for d in applied]}, other="graphql_fragment")
        elif t == "directive" and c.take("@"):
            name = c.next()
            if c.peek == "(":
                c.inside("(", ")")
            c.take("repeatable")
            places = []
            if c.take("on"):
                c.take("|")
                places.append(c.next())
                while c.take("|"):
                    places.append(c.next())
            out.entity("other", f"api-directive://graphql:{src.path}#{name}", name, line, language="graphql", payload={"protocol": "graphql", "locations": places}, other="graphql_directive")
        elif t in TYPES:
            schema_type(c, src, out, t, line)


def written(kind: dict | None) -> str | None:
    if not kind:
        return None
    inner = written(kind.get("ofType"))
    return f"{inner}!" if kind.get("kind") == "NON_NULL" else f"[{inner}]" if kind.get("kind") == "LIST" else kind.get("name")


def introspection(src: Source, out: Out) -> None:
    data = json.loads(src.text)
    root = (data.get("data") or data).get("__schema") or {}
    names = {"OBJECT": "type", "INTERFACE": "interface", "INPUT_OBJECT": "input", "ENUM": "enum", "UNION": "union", "SCALAR": "scalar"}
    for t in root.get("types") or []:
        if t["name"].startswith("__"):
            continue
        many = t.get("fields") or t.get("inputFields") or t.get("enumValues") or t.get("possibleTypes") or []
        rows = [{"name": m["name"], "type": written(m.get("type")), "arguments": [a["name"] for a in m.get("args") or []], "directives": ["deprecated"] if m.get("isDeprecated") else []} for m in many]
        schema(src, out, names.get(t.get("kind"), "type"), t["name"], 1, rows, [])
    for d in root.get("directives") or []:
        out.entity("other", f"api-directive://graphql:{src.path}#{d['name']}", d["name"], 1, language="graphql", payload={"protocol": "graphql", "locations": d.get("locations") or []}, other="graphql_directive")


EXTRACTORS = [Extractor("graphql", lambda s: s.hint in ("graphql", "graphqls"), extract), Extractor("graphql-introspection", lambda s: s.hint == "json" and '"__schema"' in s.text, introspection)]
