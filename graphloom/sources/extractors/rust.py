"""Rust: symbols with imports and calls, and the environment variables that code reads. Works on tokens, without a syntax tree."""

from __future__ import annotations

import re

from graphloom.sources.extract import Extractor, Out, Source, file_id

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<raw>b?r(?P<h>\#*)".*?"(?P=h))|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\.[^']*|[^'\\])')|(?P<life>'[A-Za-z_]\w*)"""
    r"""|(?P<id>(?:r\#)?[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|[^\s\w])""",
    re.S,
)
KEYWORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
ITEMS = {"struct": "class", "enum": "class", "trait": "class", "union": "class", "type": "symbol", "const": "symbol", "static": "symbol", "macro_rules": "symbol"}
ENV = re.compile(r"""(?:(env::var(?:_os)?|option_env!|env!|std::env::var(?:_os)?))\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)"\s*""")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) without comments."""
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "comment":
            kind = "str" if m["raw"] or m["str"] else "id" if m["id"] else "life" if m["life"] else "op" if m["op"] else "lit"
            if not m["comment"]:
                out.append((kind, m[0].removeprefix("r#") if kind == "id" else m[0], line))
    return out


def module_of(path: str) -> str:
    """The module that a file is: its package's folder, then folders and name below src."""
    parts = path.removesuffix(".rs").split("/")
    at = max((i for i, p in enumerate(parts) if p == "src"), default=-1)
    package = parts[at - 1] if at > 0 else "crate"
    rest = parts[at + 1 :] if at >= 0 else parts
    if rest and rest[-1] in ("mod", "lib", "main"):
        rest = rest[:-1]
    return "::".join([package.replace("-", "_"), *rest])


def use_paths(tree: list[str], prefix: tuple[str, ...] = ()) -> list[str]:
    """Flat paths of a use tree's tokens: groups spread out, ``self`` is the group's own path, ``as`` names are left out."""
    out, own, k = [], list(prefix), 0
    while k < len(tree):
        t = tree[k]
        if t == "{":
            depth, parts, start = 1, [], k + 1
            k += 1
            while k < len(tree) and depth:
                depth += (tree[k] == "{") - (tree[k] == "}")
                if (tree[k] == "," and depth == 1) or depth == 0:
                    parts.append(tree[start:k])
                    start = k + 1
                k += 1
            for p in parts:
                if p:
                    out += use_paths(p, tuple(own))
            return out
        if t == "as":
            break
        if t not in ("::", ","):
            own.append(t)
        k += 1
    if own and own[-1] == "self" and len(own) > 1:
        own = own[:-1]
    return [*out, "::".join(own)] if own else out


def extract(src: Source, out: Out) -> None:
    toks = tokens(src.text)
    root = module_of(src.path)
    found: dict[tuple[str, str], dict] = {}

    def symbol(kind: str, what: str, name: str, qn: str, line: int, vis: bool, test: bool = False) -> dict:
        s = found.setdefault((qn, kind), {"kind": kind, "what": what, "name": name, "qn": qn, "spans": [], "imports": [], "calls": [], "public": vis, "test": test})
        s["spans"].append([line, line])
        return s

    top = symbol("module", "module", root.rsplit("::", 1)[-1], root, 1, True)
    top["spans"] = [[1, src.text.count("\n") + 1]]
    # scopes: (name of the module or type, module, function or None), and what each open brace closes
    stack: list[tuple[str, dict, dict | None, dict | None]] = [(root, top, None, None)]
    pending, test, public, k = None, False, False, 0
    while k < len(toks):
        kind, t, line = toks[k]
        scope, module, function, _ = stack[-1]
        nxt = toks[k + 1] if k + 1 < len(toks) else ("", "", line)
        if t == "#" and nxt[1] in ("[", "!"):
            depth, j, words = 0, k + 1, []
            while j < len(toks):
                depth += (toks[j][1] == "[") - (toks[j][1] == "]")
                words.append(toks[j][1])
                j += 1
                if depth == 0 and words[-1] == "]":
                    break
            test = test or words[:2] == ["[", "test"] or words[-3:-1] == ["::", "test"] or ("::" in words and "test" in words)
            k = j
            continue
        if kind == "id" and t == "pub":
            public = True
        elif kind == "id" and t == "use" and function is None:
            j = k + 1
            while j < len(toks) and toks[j][1] != ";":
                j += 1
            module["imports"] += use_paths([x[1] for x in toks[k + 1 : j]])
            k, public, test = j, False, False
        elif kind == "id" and t == "fn" and nxt[0] == "id":
            s = symbol("test_case" if test else "function", "test" if test else "function", nxt[1], f"{scope}::{nxt[1]}", line, public, test)
            pending, public, test, k = ("fn", s), False, False, k + 1
        elif kind == "id" and t == "mod" and nxt[0] == "id":
            after = toks[k + 2][1] if k + 2 < len(toks) else ""
            if after == "{":
                pending = ("mod", symbol("module", "module", nxt[1], f"{module['qn']}::{nxt[1]}", line, public))
            public, test, k = False, False, k + 1
        elif kind == "id" and t == "impl" and function is None:
            j, depth, names = k + 1, 0, []
            while j < len(toks) and toks[j][1] not in ("{", ";"):
                depth += (toks[j][1] == "<") - (toks[j][1] == ">")
                if toks[j][1] == "for" and depth == 0:
                    names = []
                elif toks[j][1] == "where" and depth == 0:
                    break
                elif toks[j][0] == "id" and depth == 0 and toks[j][1] not in ("dyn", "mut", "crate", "self", "super"):
                    names.append(toks[j][1])
                j += 1
            pending, k = ("impl", f"{module['qn']}::{names[-1]}" if names else scope), j - 1
        elif kind == "id" and t in ITEMS and function is None and (nxt[0] == "id" or t == "macro_rules") and nxt[1] not in ("fn", "unsafe", "extern", "async"):
            name_at = k + 2 if t == "macro_rules" else k + 1
            while name_at < len(toks) and toks[name_at][1] in ("mut", "!"):
                name_at += 1
            if name_at < len(toks) and toks[name_at][0] == "id":
                name = toks[name_at][1]
                symbol(ITEMS[t], t, name, f"{scope}::{name}", line, public)
                if t == "trait":
                    pending = ("impl", f"{scope}::{name}")
            public, test, k = False, False, name_at
        elif t == "{":
            if pending and pending[0] == "fn":
                stack.append((scope, module, pending[1], pending[1]))
            elif pending and pending[0] == "mod":
                stack.append((pending[1]["qn"], pending[1], None, pending[1]))
            elif pending and pending[0] == "impl":
                stack.append((pending[1], module, None, None))
            else:
                stack.append((scope, module, function, None))
            pending = None
        elif t == "}":
            if len(stack) > 1:
                closed = stack.pop()[3]
                if closed:
                    closed["spans"][-1][1] = line
        elif t == ";":
            pending, public, test = None, False, False
        elif function is not None and kind == "id" and t not in KEYWORDS - {"crate", "self", "super", "Self"} and (k == 0 or toks[k - 1][1] not in ("::", ".", "fn")):
            path, j = [t], k + 1
            while j + 1 < len(toks) and toks[j][1] == "::" and toks[j + 1][0] == "id":
                path.append(toks[j + 1][1])
                j += 2
            if j < len(toks) and toks[j][1] == "(" and path[-1] not in KEYWORDS:
                owner = scope if path[0] == "Self" else None
                call = "::".join([*(["self"] if owner and False else []), *path])
                if owner:
                    call = "::".join(["crate", *owner.split("::")[1:], *path[1:]])
                if call not in function["calls"]:
                    function["calls"].append(call)
                k = j - 1
        k += 1
    file = file_id(src.path)
    for s in found.values():
        key = f"symbol://rust:{s['qn']}"
        i = out.entity(
            s["kind"], key, s["name"], min(a for a, _ in s["spans"]), max(b for _, b in s["spans"]), language="rust",
            payload={"symbol_kind": s["what"], "qualified_name": s["qn"], "visibility": "public" if s["public"] else "private", "definitions": len(s["spans"]), "imports": s["imports"], "calls": s["calls"], "is_test": s["test"]},
        )
        out.fact("symbol_defined", i, {"stable_key": key, "path": src.path, "symbol_kind": s["what"]}, s["spans"][0][0], object=file)
    code = re.sub(r"//[^\n]*", "", src.text)
    for m in ENV.finditer(code):
        line = code.count("\n", 0, m.start()) + 1
        i = out.entity("env_var", f"env://{m[2]}", m[2], line, language="rust", payload={"name": m[2], "source_kind": "rust", "has_default": False})
        out.fact("env_var_used", i, {"name": m[2], "mechanism": m[1].rstrip("!").split("::")[-1], "source_kind": "rust"}, line, object=file)


EXTRACTORS = [Extractor("rust", lambda s: s.hint == "rust", extract)]
