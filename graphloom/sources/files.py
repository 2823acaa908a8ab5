"""Source files as rows: path, language_hint, content_hash, content."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a64_bytes
from graphloom.plans.staging import file_system

IGNORED = (".git", "target", "node_modules", ".idea", ".vscode")
#: Endings whose language is named otherwise.
LANGUAGES = {
    "rs": "rust", "md": "markdown", "mdx": "markdown", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "yml": "yaml", "gql": "graphql", "sh": "shell",
}


def language_hint(path: Column) -> Column:
    """The language of a path's ending; other endings as they are, in lower case; null without one."""
    ending = F.lower(F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.coalesce(ending, F.lit(""))), ending)


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``; both may be written with or without a scheme."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9+]+:/*", "/")
    base = plain(F.lit(root.rstrip("/") + "/"))
    return F.when(plain(path).startswith(base), F.substring(plain(path), F.length(base) + 1, F.length(path))).otherwise(path)


def hidden_files(spark: SparkSession, root: str, names: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, length, content) of files that Spark's own listing leaves out: any part of their path begins with . or _.

    The driver lists the folder; executors read what is found.
    """
    fs, top = file_system(spark, root)
    todo, found = [(top, False)], []
    while todo:
        at, inside = todo.pop()
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            hid = inside or name[0] in "._"
            if s.isDirectory():
                if name not in names:
                    todo.append((s.getPath(), hid))
            elif hid:
                found.append((s.getPath().toString(), s.getLen()))

    def read(batches):
        from pyarrow import fs as pafs

        for b in batches:
            data = []
            for path in b["path"]:
                store, p = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with store.open_input_stream(p) as f:
                    data.append(f.read())
            yield b.assign(content=data)

    rows = spark.createDataFrame(found, "path string, length long")
    return rows.repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism))).mapInPandas(read, "path string, length long, content binary")


def scan(spark: SparkSession, root: str, names: tuple[str, ...] = IGNORED, most: int = 64 << 20, hidden: bool = True) -> DataFrame:
    """All files below a folder of any file system that Spark reads, without ignored folders.

    content is null where a file isn't UTF-8. Files over ``most`` bytes are listed without content, with a hash of another kind (XXH64),
    so that a change of theirs is seen. Without ``hidden`` files
    below names that begin with . or _ are left out, and the driver lists nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    if hidden:
        files = files.unionByName(hidden_files(spark, root, names))
    path = relative(F.col("path"), root)
    small = F.col("length") <= most
    body = F.when(small, F.col("content"))
    return files.where(~ignored(path, names)).select(
        path.alias("path"),
        language_hint(path).alias("language_hint"),
        F.when(small, F.concat(F.lit("fnv1a64:"), fnv1a64_bytes(body))).otherwise(F.concat(F.lit("xxh64:"), F.hex(F.xxhash64("content")))).alias("content_hash"),
        F.try_validate_utf8(body.cast("string")).alias("content"),
    )


def read_one(spark: SparkSession, root: str, path: str) -> DataFrame:
    return scan(spark, root).where(F.col("path") == path)


def selected(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of listed paths (path)."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def merged(*files: DataFrame) -> DataFrame:
    """Rows of several sources in their order; a path of several sources is the first's."""
    rows = None
    for n, f in enumerate(files):
        own = f.select("path", "language_hint", "content_hash", "content", F.lit(n).alias("n"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("path").agg(F.min("n").alias("n"))
    return rows.join(first, ["path", "n"], "left_semi").select("path", "language_hint", "content_hash", "content")


def file_state(files: DataFrame, snapshot: str) -> DataFrame:
    return files.select(F.lit(snapshot).alias("snapshot"), "path", "content_hash", "language_hint")


def working_tree(spark: SparkSession, root: str, runner=subprocess.run) -> DataFrame | None:
    """(path, state) of what git reports as changed below a local folder; None if it isn't a working tree (then compare states)."""
    try:
        got = runner(["git", "-C", root, "status", "--porcelain=v1", "-z"], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if got.returncode else spark.createDataFrame(porcelain(got.stdout.decode("utf-8", "replace")), "path string, state string")


def porcelain(text: str) -> list[tuple[str, str]]:
    """(path, changed or removed) of ``git status --porcelain=v1 -z``: a rename is its new path, and its old one removed."""
    out, parts = [], text.split("\0")
    at = 0
    while at < len(parts):
        entry = parts[at]
        at += 1
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        if code[0] in "RC":
            if code[0] == "R" and at < len(parts):
                out.append((parts[at], "removed"))
            at += 1
        out.append((path, "removed" if "D" in code else "changed"))
    return out
