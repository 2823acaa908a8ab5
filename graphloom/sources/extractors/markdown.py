"""Markdown: pages, sections, runbooks and their steps."""

from __future__ import annotations

import re
from urllib.parse import quote

import yaml

from graphloom.sources.extract import Extractor, Out, Source

#: The safe loader over libyaml, where that is installed: some ten times faster.
YAML = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
STEP = re.compile(r"^ {0,3}(\d+)[.)][ \t]+(.+)$")


def front_matter(text: str) -> tuple[dict, int]:
    """Fields of the YAML between the first two lines of dashes, and the line number that the body begins after."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}, 0
    for n, line in enumerate(lines[1:], 1):
        if line.strip() in ("---", "..."):
            try:
                got = yaml.load("\n".join(lines[1:n]), YAML)
            except yaml.YAMLError:
                got = None
            return (got if isinstance(got, dict) else {}), n + 1
    return {}, 0


def body_lines(text: str, after: int) -> list[tuple[int, str]]:
    """(number, line) outside of fenced code; numbers from 1 for the whole file."""
    out, fence = [], None
    for n, line in enumerate(text.split("\n")[after:], after + 1):
        m = FENCE.match(line)
        if fence is None and m:
            fence = m[1][0] * 3
            out.append((n, ""))
        elif fence is not None:
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
            out.append((n, ""))
        else:
            out.append((n, line.rstrip("\r")))
    return out


def headings(lines: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(line, level, title) of ATX and setext headings."""
    out = []
    for k, (n, line) in enumerate(lines):
        if m := ATX.match(line):
            title = re.sub(r"[ \t]+#+$", "", m[2] or "").strip().rstrip("#").strip() if (m[2] or "").strip("#") else ""
            if title:
                out.append((n, len(m[1]), title))
        elif k and (m := SETEXT.match(line)) and lines[k - 1][1].strip() and not ATX.match(lines[k - 1][1]) and not re.match(r"\s*([-*+>|]|\d+[.)])", lines[k - 1][1]):
            out.append((n - 1, 1 if m[1][0] == "=" else 2, lines[k - 1][1].strip()))
    return out


def slug(title: str) -> str:
    """Lower case; ASCII letters and digits kept, other letters percent-encoded, runs of anything else one dash."""
    out = []
    for c in title.lower():
        if c.isascii() and c.isalnum():
            out.append(c)
        elif not c.isascii() and c.isalnum():
            out.append(quote(c))
        elif out and out[-1] != "-":
            out.append("-")
    return "".join(out).strip("-") or "section"


def listed(x) -> list[str]:
    return [str(i) for i in x] if isinstance(x, list) else [str(x)] if x not in (None, "") else []


def extract(src: Source, out: Out) -> None:
    meta, after = front_matter(src.text)
    lines = body_lines(src.text, after)
    found = headings(lines)
    kind = meta.get("kind")
    key = f"doc://{meta['id']}" if meta.get("id") else f"doc://{src.path}"
    language = str(meta.get("language") or "markdown")
    said = {k: meta.get(k) for k in ("status", "last_verified_snapshot", "source_language")}
    layer = str(meta.get("layer") or ("generated" if "/generated/" in f"/{src.path}" else "editable"))
    page = out.entity(
        "documentation_page", key, src.path, 1, src.text.count("\n") + 1, title=next((t for _, level, t in found if level == 1), None), language=language,
        payload={"content_hash": src.content_hash, "frontmatter_present": after > 0, "frontmatter_fields": meta, "documentation_layer": layer, "documentation_kind": kind, "concepts": listed(meta.get("concepts")), "entities": listed(meta.get("entities")), "text": " ".join(t for _, _, t in found), **said},
    )
    seen: dict[str, int] = {}
    for n, level, title in found:
        base = slug(title)
        seen[base] = seen.get(base, 0) + 1
        own = base if seen[base] == 1 else f"{base}-{seen[base]}"
        section = out.entity("documentation_section", f"{key}#{own}", title, n, title=title, language=language, payload={"level": level, "slug": own, "documentation_page": key, "documentation_layer": layer, "documentation_kind": kind})
        out.fact("doc_section_found", page, {"title": title, "level": level, "slug": own}, n, object=section)
    if kind == "runbook":
        runbook_key = f"runbook://{key.removeprefix('doc://')}"
        out.entity("runbook", runbook_key, src.path, 1, title=next((t for _, level, t in found if level == 1), None), language=language, payload={"documentation_page": key, "targets": listed(meta.get("targets")) or listed(meta.get("entities"))})
        steps = [(n, m[2].strip()) for n, line in lines if (m := STEP.match(line))]
        for k, (n, text) in enumerate(steps, 1):
            out.entity("operation_step", f"{runbook_key}#step-{k}", text, n, title=text, language=language, payload={"runbook": runbook_key, "sequence": k, "text": text})


EXTRACTORS = [Extractor("markdown", lambda s: s.hint == "markdown", extract)]
