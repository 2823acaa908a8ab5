"""JavaScript and TypeScript modules and their declarations; npm manifests."""

from __future__ import annotations

import json
import re

from graphloom.sources.extract import Extractor, Out, Source, file_id

#: Comments, strings and templates, to be blanked so that braces and words in them do not count.
QUIET = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?:[\w*${}\s,]+?\s+from\s+)?["']([^"'\n]+)["']|\bimport\s*\(\s*["']([^"'\n]+)["']\s*\)|\brequire\s*\(\s*["']([^"'\n]+)["']\s*\)|\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+["']([^"'\n]+)["']""")
DECLARED = re.compile(
    r"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?P<async>async\s+)?(?:(?P<what>function\s*\*?|class|interface|enum|namespace)\s+(?P<name>[A-Za-z_$][\w$]*)|type\s+(?P<alias>[A-Za-z_$][\w$]*)\s*(?:<[^=;]*>)?\s*=|(?:const|let|var)\s+(?P<var>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?P<va>async\s+)?(?P<fn>function\b|(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]+)?=>)?)"
)
METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?\s*\([^()]*\)\s*(?::[^{;]+)?\{")
EXPORTS = re.compile(r"\bexport\s*\{([^}]*)\}")
KINDS = {"function": "function", "class": "class", "interface": "class", "enum": "class", "namespace": "module"}


def blanked(text: str, strings: bool = True) -> str:
    """The text with comments, and strings if wanted, as blanks of the same length."""
    return QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0][:2] in ("//", "/*") else m[0], text)


def depths(code: str) -> list[int]:
    out, d = [], 0
    for c in code:
        if c in ")}]":
            d = max(0, d - 1)
        out.append(d)
        if c in "({[":
            d += 1
    return out


def imbalance(code: str) -> tuple[int, str] | None:
    """The place and kind of the first bracket that does not match, if any."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for i, c in enumerate(code):
        if c in "([{":
            stack.append((i, c))
        elif c in pairs:
            if not stack or stack.pop()[1] != pairs[c]:
                return i, f"unexpected {c}"
    return (stack[-1][0], f"unclosed {stack[-1][1]}") if stack else None


def extract(src: Source, out: Out) -> None:
    code, lined = blanked(src.text), lambda i: src.text.count("\n", 0, i) + 1
    imports = list(dict.fromkeys(next(g for g in m.groups() if g) for m in IMPORT.finditer(blanked(src.text, strings=False))))
    at = depths(code)
    exported = {w.split(" as ")[0].strip() for m in EXPORTS.finditer(code) for w in m[1].split(",") if w.strip()}
    rows = []
    for m in DECLARED.finditer(code):
        if at[m.start()] or (m.start() and (code[m.start() - 1].isalnum() or code[m.start() - 1] in "_$.")):
            continue
        what = (m["what"] or "").split()[0].rstrip("*") if m["what"] else "type_alias" if m["alias"] else "function" if m["fn"] else "variable"
        name = m["name"] or m["alias"] or m["var"]
        kind = KINDS.get(what, "symbol")
        end = m.end()
        if what in ("class", "interface", "function", "enum", "namespace") or m["fn"]:
            open_ = code.find("{", m.end())
            if open_ >= 0:
                end = next((i for i in range(open_ + 1, len(code)) if code[i] == "}" and at[i] == at[open_]), len(code) - 1)
        rows.append((name, name, kind, what, bool(m["export"]) or name in exported, bool(m["async"] or m["va"]), m.start(), end))
        if what == "class":
            open_ = code.find("{", m.end())
            for x in METHOD.finditer(code, open_, end + 1) if open_ >= 0 else ():
                if at[x.start("name")] == at[open_] + 1 and x["name"] not in ("if", "for", "while", "switch", "catch", "function", "return"):
                    rows.append((x["name"], f"{name}.{x['name']}", "function", "method", False, "async" in x[0].split(x["name"])[0], x.start("name"), x.start("name")))
    module_key = f"module://js-ts:{src.path}"
    stem = re.sub(r"(\.d)?\.[a-z]+$", "", src.name)
    name = src.path.split("/")[-2] if stem == "index" and "/" in src.path else stem
    module = out.entity("module", module_key, name, 1, src.text.count("\n") + 1, language=src.hint, payload={"imports": imports, "exports": sorted({r[0] for r in rows if r[4]} | exported), "declaration_count": len(rows)})
    out.fact("symbol_defined", module, {"stable_key": module_key, "path": src.path, "symbol_kind": "module"}, 1, object=file_id(src.path))
    for name, qn, kind, what, public, is_async, start, end in rows:
        key = f"symbol://js-ts:{src.path}#{qn}"
        i = out.entity(kind, key, name, lined(start), lined(end), language=src.hint, payload={"symbol_kind": what, "qualified_name": qn, "exported": public, "async": is_async})
        out.fact("symbol_defined", i, {"stable_key": key, "path": src.path, "symbol_kind": what}, lined(start), object=module)
    if bad := imbalance(code):
        out.diagnostic("other", "medium", f"parse error: {bad[1]}", [module], lined(bad[0]), other="js_ts_parse_error")


def manifest(src: Source, out: Out) -> None:
    data = json.loads(src.text)
    name = data.get("name") or src.path
    package = out.entity("package", f"package://npm:{name}", name, 1, language="json", payload={"version": data.get("version"), "private": bool(data.get("private")), "scripts": sorted(data.get("scripts") or {})})
    out.fact("symbol_defined", package, {"stable_key": f"package://npm:{name}", "path": src.path, "source_kind": "package_json"}, 1, object=file_id(src.path))
    for group in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for dep, version in (data.get(group) or {}).items():
            i = out.entity("dependency", f"dependency://npm:{dep}", dep, 1, language="json", payload={"ecosystem": "npm"})
            out.fact("other", package, {"dependency": dep, "group": group, "version": version}, 1, object=i, other="depends_on")


EXTRACTORS = [Extractor("js-ts", lambda s: s.hint in ("typescript", "javascript"), extract), Extractor("npm", lambda s: s.name == "package.json", manifest)]
