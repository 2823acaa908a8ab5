"""Domain adapters: user-interface surfaces, backend contracts and page builders, from registries and marked sources.

Surfaces: a source file under ``.../surfaces/<module>/<surface>/<role>/`` is part of a layer; markers come from what it
imports. Contracts and page builders: JSON registries whose ``registry`` is ``backend_contract`` or ``page_builder``.
"""

from __future__ import annotations

import json
import re

from graphloom.sources.extract import Extractor, Out, Source, file_id

LAYER = re.compile(r"(?:^|/)surfaces/([\w-]+)/([\w-]+)/(core|transport|ui|host)/")
STATUS = re.compile(r"^\s*[-*]\s*(surface|contract)\s+([\w-]+)(?:/([\w-]+))?\s*:\s*([\w+]+)\s*$", re.M)


def surface(src: Source, out: Out) -> None:
    module, name, role = LAYER.search(src.path).groups()
    out.entity("other", f"ffa_surface://{module}/{name}", name, 1, payload={"module": module, "surface": name}, other="ffa_surface")
    layer = out.entity("other", f"ffa_layer://{module}/{name}/{role}", role, 1, payload={"module": module, "surface": name, "role": role}, other="ffa_layer")
    rules = (("core", "imports_ui", r"(surfaces::[\w:]*ui|/ui/)"), ("ui", "raw_transport", r"\b(fetch\s*\(|reqwest::|XMLHttpRequest)"), ("host", "owns_ui", r"\b(render|view!|<div)"), ("transport", "profile", r"\bprofile\b"))
    marks = [m for r, m, p in rules if r == role and re.search(p, src.text)] or ["present"]
    for m in marks:
        out.fact("other", layer, {"module": module, "surface": name, "role": role, "marker": m}, 1, object=file_id(src.path), other="ffa_layer_marker")


def statuses(src: Source, out: Out) -> None:
    for m in STATUS.finditer(src.text):
        line = src.text.count("\n", 0, m.start()) + 1
        if m[1] == "surface" and m[3]:
            out.fact("other", file_id(src.path), {"module": m[2], "surface": m[3], "shape": m[4]}, line, other="ffa_docs_status")
        elif m[1] == "contract":
            out.fact("other", file_id(src.path), {"module": m[2], "status": m[4]}, line, other="fba_docs_status")


def contracts(src: Source, out: Out) -> None:
    for m in json.loads(src.text).get("modules") or []:
        name = m["name"]
        own = out.entity("other", f"fba_module://{name}", name, 1, payload=m, other="fba_module")
        for r, state in sorted((m.get("requirements") or {}).items()):
            out.fact("other", own, {"requirement": r, "state": state}, 1, other="fba_requirement")
        for c in m.get("contracts") or []:
            out.entity("other", f"fba_contract://{name}/{c}", c, 1, payload={"module": name}, other="fba_contract")
        for p in m.get("ports") or []:
            out.entity("other", f"fba_port://{name}/{p['name']}", p["name"], 1, payload=p | {"module": name}, other="fba_port")
            for o in p.get("operations") or []:
                out.entity("other", f"fba_operation://{name}/{p['name']}/{o['name']}", o["name"], 1, payload=o | {"module": name, "port": p["name"]}, other="fba_operation")
        for d in m.get("dependencies") or []:
            out.entity("other", f"fba_dependency://{name}/{d['provider']}/{d.get('profile', 'default')}", d["provider"], 1, payload=d, other="fba_dependency")


def port_code(src: Source, out: Out) -> None:
    """Traits named ...Port in a module's folder, with their functions."""
    m = re.search(r"(?:^|/)(?:modules|crates)/([\w-]+)/", src.path)
    for t in re.finditer(r"\btrait\s+(\w+Port)\b[^{]*\{(.*?)\n\}", src.text, re.S):
        line = src.text.count("\n", 0, t.start()) + 1
        out.fact("other", file_id(src.path), {"module": m[1] if m else None, "port": t[1], "operations": re.findall(r"\bfn\s+(\w+)", t[2])}, line, other="fba_port_code")


def page_builder(src: Source, out: Out) -> None:
    data = json.loads(src.text)
    for p in data.get("providers") or []:
        out.entity("other", f"page_builder_provider://{p['name']}", p["name"], 1, payload=p, other="page_builder_provider")
    for c in data.get("consumers") or []:
        out.entity("other", f"page_builder_consumer://{c['name']}", c["name"], 1, payload=c, other="page_builder_consumer")
    for kind in ("profile", "wave", "host"):
        for x in data.get(f"{kind}s") or []:
            out.entity("other", f"page_builder_{kind}://{x['name']}", x["name"], 1, payload=x, other=f"page_builder_{kind}")


def registry(kind: str):
    return lambda s: s.hint == "json" and re.search(rf'"registry"\s*:\s*"{kind}"', s.text) is not None


EXTRACTORS = [
    Extractor("adapter-ffa", lambda s: LAYER.search(s.path) is not None, surface),
    Extractor("adapter-docs", lambda s: s.hint == "markdown", statuses),
    Extractor("adapter-fba", registry("backend_contract"), contracts),
    Extractor("adapter-fba-code", lambda s: s.hint == "rust" and "Port" in s.text, port_code),
    Extractor("adapter-page-builder", registry("page_builder"), page_builder),
]
