"""Operations files: environment, build, container, deployment, migration, configuration and CI formats."""

from __future__ import annotations

import re
import tomllib

import yaml

from graphloom.sources.extract import Extractor, Out, Source, file_id

ENV_LINE = re.compile(r"^\s*(export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$")
TARGET = re.compile(r"^([A-Za-z0-9_][A-Za-z0-9_./-]*(?:[ \t]+[A-Za-z0-9_][A-Za-z0-9_./-]*)*)[ \t]*:(?![=:])([^#\n]*)")
FUNCTION = re.compile(r"^\s*(?:function\s+([A-Za-z_][\w-]*)\s*(?:\(\s*\))?|([A-Za-z_][\w-]*)\s*\(\s*\))\s*\{?")
TABLE = re.compile(r"\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:[\"`\[]?\w+[\"`\]]?\s*\.\s*)?[\"`\[]?\w+[\"`\]]?)", re.I)


def documents(text: str) -> list[dict]:
    try:
        return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


def line_of(text: str, word: str) -> int:
    at = text.find(word)
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


def declared(src: Source, out: Out, kind: str, key: str, name: str, line: int, source_kind: str, payload: dict, fact: str = "symbol_defined", title: str | None = None, language: str | None = None) -> str:
    i = out.entity(kind, key, name, line, title=title, language=language or source_kind, payload=payload)
    out.fact(fact, i, {"stable_key": key, "path": src.path, "source_kind": source_kind}, line, object=file_id(src.path))
    return i


def env(src: Source, out: Out) -> None:
    """Names with whether they have a value; values are never kept."""
    kind = "dotenv" if src.name.startswith(".env") or src.name.endswith(".env") else "shell"
    for n, line in enumerate(src.text.split("\n"), 1):
        m = ENV_LINE.match(line)
        if m and (kind == "dotenv" or m[1]):
            has = bool(m[3].strip().strip("\"'"))
            i = out.entity("env_var", f"env://{m[2]}", m[2], n, language=kind, payload={"name": m[2], "source_kind": kind, "has_default": has, "value_redacted": has})
            out.fact("env_var_used", i, {"name": m[2], "mechanism": kind, "source_kind": kind, "has_default": has, "value_redacted": has}, n, object=file_id(src.path))


def makefile(src: Source, out: Out) -> None:
    for n, line in enumerate(src.text.split("\n"), 1):
        if m := TARGET.match(line):
            for name in m[1].split():
                declared(src, out, "script_command", f"script-command://{src.path}#target:{name}", name, n, "makefile", {"command_kind": "make_target", "target": name, "prerequisites": m[2].split()}, title=f"make {name}")


def cargo(src: Source, out: Out) -> None:
    data = tomllib.loads(src.text)
    package = data.get("package") or {}
    owner = file_id(src.path)
    if name := package.get("name"):
        version = package.get("version")
        owner = declared(src, out, "package", f"package://cargo:{name}", name, line_of(src.text, "[package]"), "cargo", {"version": version if isinstance(version, str) else None, "ecosystem": "cargo"})
    groups = {g: data.get(g) or {} for g in ("dependencies", "dev-dependencies", "build-dependencies")} | {"workspace-dependencies": (data.get("workspace") or {}).get("dependencies") or {}}
    for target in (data.get("target") or {}).values():
        groups["dependencies"] = groups["dependencies"] | (target.get("dependencies") or {})
    for group, deps in groups.items():
        for dep, spec in sorted(deps.items()):
            spec = spec if isinstance(spec, dict) else {"version": spec}
            i = out.entity("dependency", f"dependency://cargo:{spec.get('package', dep)}", spec.get("package", dep), line_of(src.text, dep), language="toml", payload={"ecosystem": "cargo"})
            out.fact("other", owner, {"dependency": dep, "group": group, "version": spec.get("version"), "optional": bool(spec.get("optional")), "workspace": bool(spec.get("workspace"))}, line_of(src.text, dep), object=i, other="depends_on")


def dockerfile(src: Source, out: Out) -> None:
    instructions, held, start = [], "", 0
    for n, line in enumerate(src.text.split("\n"), 1):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        start = start or n
        held += s.removesuffix("\\") + " "
        if not s.endswith("\\"):
            word, _, rest = held.strip().partition(" ")
            instructions.append((start, word.upper(), rest.strip()))
            held, start = "", 0
    stage, k = "file", 0
    for n, word, rest in instructions:
        if word == "FROM":
            parts = [p for p in rest.split() if not p.startswith("--")]
            stage = parts[2] if len(parts) > 2 and parts[1].lower() == "as" else f"stage-{k + 1}"
            k += 1
            declared(src, out, "docker_service", f"docker://{src.path}#{stage}", stage, n, "dockerfile", {"service_kind": "dockerfile_stage", "image": parts[0] if parts else None, "stage": stage}, title=f"Docker stage {stage}")
        elif word in ("RUN", "CMD", "ENTRYPOINT"):
            declared(src, out, "script_command", f"script-command://{src.path}#{stage}:{word.lower()}:{n}", f"{word} {stage}", n, "dockerfile", {"command_kind": f"dockerfile_{word.lower()}", "command": rest, "stage": stage})
        elif word in ("ENV", "ARG"):
            for name in re.findall(r"([A-Za-z_]\w*)=", rest) or rest.split()[:1]:
                declared(src, out, "env_var", f"env://{name}", name, n, "dockerfile", {"name": name, "source_kind": "dockerfile", "has_default": "=" in rest}, fact="env_var_used")


def shell(src: Source, out: Out) -> None:
    for n, line in enumerate(src.text.split("\n"), 1):
        if (m := FUNCTION.match(line)) and (name := m[1] or m[2]) not in ("if", "while", "for", "case"):
            declared(src, out, "script_command", f"script-command://{src.path}#function:{name}", name, n, "shell", {"command_kind": "shell_function"})


def environment_names(x) -> list[str]:
    return sorted(map(str, x)) if isinstance(x, dict) else sorted(str(i).split("=")[0] for i in x) if isinstance(x, list) else []


def compose(src: Source, out: Out) -> None:
    for doc in documents(src.text):
        for name, s in (doc.get("services") or {}).items():
            s = s if isinstance(s, dict) else {}
            n = line_of(src.text, f"{name}:")
            build = s.get("build")
            declared(src, out, "docker_service", f"docker://{src.path}#{name}", name, n, "compose", {"service_kind": "compose_service", "image": s.get("image"), "build": build.get("context") if isinstance(build, dict) else build, "depends_on": sorted(s.get("depends_on") or []), "ports": [str(p) for p in s.get("ports") or []]})
            if s.get("command"):
                declared(src, out, "script_command", f"script-command://{src.path}#{name}:command", f"{name} command", n, "compose", {"command_kind": "compose_command", "command": s["command"], "service": name})
            for v in environment_names(s.get("environment")):
                declared(src, out, "env_var", f"env://{v}", v, line_of(src.text, v), "compose", {"name": v, "source_kind": "compose"}, fact="env_var_used")


def kubernetes(src: Source, out: Out) -> None:
    for doc in documents(src.text):
        kind, name = doc.get("kind"), (doc.get("metadata") or {}).get("name")
        if not kind or not name or "apiVersion" not in doc:
            continue
        n = line_of(src.text, f"name: {name}")
        declared(src, out, "docker_service", f"kubernetes://{src.path}#{kind}/{name}", name, n, "kubernetes", {"service_kind": f"kubernetes_{kind.lower()}", "namespace": (doc.get("metadata") or {}).get("namespace")})
        spec = doc.get("spec") or {}
        for _ in range(3):  # CronJob, then Job, then Pod
            spec = (spec.get("jobTemplate") or spec.get("template") or {}).get("spec") or spec
        for c in spec.get("containers") or []:
            command = [*(c.get("command") or []), *(c.get("args") or [])]
            if command:
                declared(src, out, "script_command", f"script-command://{src.path}#{kind}/{name}:{c.get('name')}", f"{name} {c.get('name')}", n, "kubernetes", {"command_kind": "kubernetes_command", "command": command, "image": c.get("image")})
            for e in c.get("env") or []:
                declared(src, out, "env_var", f"env://{e['name']}", e["name"], line_of(src.text, e["name"]), "kubernetes", {"name": e["name"], "source_kind": "kubernetes"}, fact="env_var_used")


def migration(src: Source, out: Out) -> None:
    code = re.sub(r"--[^\n]*", lambda m: " " * len(m[0]), src.text)
    made = [(code.count("\n", 0, m.start()) + 1, re.sub(r"[\"`\[\]\s]", "", m[1])) for m in TABLE.finditer(code)]
    own = declared(src, out, "db_migration", f"db-migration://{src.path}", src.name.removesuffix(".sql"), 1, "database_migration", {"migration_kind": "sql_migration", "path": src.path, "created_tables": [t for _, t in made]}, title=f"Database migration {src.name.removesuffix('.sql')}", language="sql")
    for n, table in dict((t, (n, t)) for n, t in reversed(made)).values():
        i = out.entity("db_table", f"db-table://{table}", table.split(".")[-1], n, language="sql", payload={"qualified_name": table})
        out.fact("migration_creates_table", own, {"table": table}, n, object=i)


def leaves(x, prefix: str = "") -> list[str]:
    """Dotted names of all values below objects; lists are values."""
    if not isinstance(x, dict):
        return [prefix] if prefix else []
    return [k for name, v in x.items() for k in leaves(v, f"{prefix}.{name}" if prefix else str(name))]


def configuration(src: Source, out: Out) -> None:
    data = tomllib.loads(src.text) if src.hint == "toml" else yaml.safe_load(src.text)
    for key in leaves(data if isinstance(data, dict) else {}):
        declared(src, out, "feature", f"config://{src.path}#{key}", key, line_of(src.text, key.split(".")[-1]), "runtime_config", {"feature_kind": "runtime_config_key", "key": key})


def workflow(src: Source, out: Out) -> None:
    for doc in documents(src.text):
        name = str(doc.get("name") or src.name)
        top = declared(src, out, "script_command", f"script-command://{src.path}#workflow", name, 1, "ci_workflow", {"command_kind": "ci_workflow", "jobs": sorted(doc.get("jobs") or {})})
        for job, j in (doc.get("jobs") or {}).items():
            n = line_of(src.text, f"{job}:")
            own = declared(src, out, "ci_job", f"ci-job://{src.path}#{job}", str((j or {}).get("name") or job), n, "ci_workflow", {"command_kind": "ci_job", "job": job, "needs": (j or {}).get("needs") or [], "runs_on": (j or {}).get("runs-on")})
            out.fact("other", top, {"job": job}, n, object=own, other="ci_workflow_has_job")
            for k, step in enumerate((j or {}).get("steps") or [], 1):
                kind = "run" if "run" in step else "uses"
                label = str(step.get("name") or str(step.get(kind) or "").split("\n")[0])
                declared(src, out, "script_command", f"script-command://{src.path}#{job}:step-{k}", label, line_of(src.text, label), "ci_workflow", {"command_kind": f"ci_step_{kind}", "command": step.get(kind), "job": job, "sequence": k})


def is_env(s: Source) -> bool:
    return s.name == ".env" or s.name.startswith(".env.") or s.name.endswith(".env") or s.hint in ("shell", "bash")


EXTRACTORS = [
    Extractor("operations-env", is_env, env),
    Extractor("operations-makefile", lambda s: s.name in ("Makefile", "makefile", "GNUmakefile") or s.name.endswith(".mk"), makefile),
    Extractor("operations-cargo", lambda s: s.name == "Cargo.toml", cargo),
    Extractor("operations-dockerfile", lambda s: s.name == "Dockerfile" or s.name.startswith("Dockerfile.") or s.name.endswith(".Dockerfile"), dockerfile),
    Extractor("operations-shell", lambda s: s.hint in ("shell", "bash"), shell),
    Extractor("operations-compose", lambda s: bool(re.fullmatch(r"(docker-)?compose[\w.-]*\.ya?ml", s.name)), compose),
    Extractor("operations-kubernetes", lambda s: s.hint == "yaml" and bool(re.search(r"^apiVersion:", s.text, re.M)) and bool(re.search(r"^kind:", s.text, re.M)), kubernetes),
    Extractor("operations-migration", lambda s: s.hint == "sql" and bool({"migrations", "migration", "migrate"} & set(s.path.split("/"))), migration),
    Extractor("operations-config", lambda s: s.hint in ("toml", "yaml") and "config" in s.path.split("/")[:-1] and ".github" not in s.path.split("/"), configuration),
    Extractor("operations-ci", lambda s: s.hint == "yaml" and ".github/workflows/" in f"/{s.path}", workflow),
]
