"""Extraction: files to entities, facts and diagnostics, in one pass over the sources.

An extractor is a function of one file. All run side by side over Arrow batches; their rows, of one common shape, are staged once, joined by the inventory and
split into the canonical tables. Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import EVIDENCE, KnowledgeGraph, conform
from graphloom.operators.incremental import merge_entities
from graphloom.plans.staging import stage
from graphloom.sources.files import file_state

ROWS = (
    "table string, id string, stable_key string, kind string, kind_other string, name string, title string, path string, line_start int, line_end int, language string, "
    "aliases array<string>, payload string, subject string, object string, value string, extractor string, confidence float, severity string, message string"
)
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def fnv(text: str) -> str:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@dataclass
class Source:
    path: str
    hint: str | None
    content_hash: str | None
    text: str

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


@dataclass
class Out:
    """What one extractor says of one file. An id of a fact or diagnostic is the text that ``batch_of`` makes it of."""

    extractor: str
    path: str
    rows: list[dict] = field(default_factory=list)

    def _row(self, **x) -> None:
        self.rows.append(dict.fromkeys(COLUMNS) | {"path": self.path, "extractor": self.extractor} | x)

    def entity(self, kind: str, key: str, name: str, line: int | None = None, end: int | None = None, *, title=None, language=None, aliases=(), payload=None, other: str | None = None) -> str:
        i = f"ent_{fnv(key)}"
        self._row(table="entities", id=i, stable_key=key, kind=kind, kind_other=other, name=name, title=title, line_start=line, line_end=end or line, language=language, aliases=list(aliases), payload=dumped(payload or {}))
        return i

    def fact(self, kind: str, subject: str, value, line: int | None = None, *, object=None, confidence: float = 1.0, other: str | None = None) -> None:  # noqa: A002
        text = dumped(value)
        self._row(table="facts", id=chr(0).join((other or kind, subject, object or "", self.path, str(line), text)), kind=kind, kind_other=other, subject=subject, object=object, value=text, line_start=line, line_end=line, confidence=confidence)

    def diagnostic(self, kind: str, severity: str, message: str, entities: list[str], line: int | None = None, *, other: str | None = None) -> None:
        self._row(table="diagnostics", id=chr(0).join((other or kind, self.path, str(line), message)), kind=kind, kind_other=other, severity=severity, message=message, name=message, aliases=entities, line_start=line, line_end=line, confidence=1.0)


ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def dumped(x) -> str:
    return ENCODER.encode(x)


@lru_cache(1024)
def file_id(path: str) -> str:
    return f"ent_{fnv('file://' + path)}"


@dataclass(frozen=True)
class Extractor:
    name: str
    supports: Callable[[Source], bool]
    extract: Callable[[Source, Out], None]
    #: What a change of a file of this extractor asks for: see planned_scope.
    invalidation: tuple[tuple[str, str], ...] = (("add", "file_local"), ("remove", "file_local"), ("change", "file_local"))


#: Files whose rows make one batch.
TOGETHER = 1000
PREFIXES = {"facts": "fact_", "diagnostics": "diag_"}


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch, with the ids of facts and diagnostics hashed side by side."""
    from graphloom.functions.text import fnv_of

    open_ = [r for r in rows if r["table"] in PREFIXES]
    for r, h in zip(open_, fnv_of(pa.array([r["id"] for r in open_], pa.string())).to_pylist(), strict=True):
        r["id"] = PREFIXES[r["table"]] + h
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def run(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Rows of all extractors over all files with content. An extractor that fails on a file says so in a diagnostic."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ROWS))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for at in range(0, whole.num_rows, TOGETHER) for part in (whole.slice(at, TOGETHER),)):
            rows: list[dict] = []
            for path, hint, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                src = Source(path, hint, digest, text)
                for x in extractors:
                    if not x.supports(src):
                        continue
                    out = Out(x.name, path)
                    try:
                        x.extract(src, out)
                    except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError) as e:
                        out = Out(x.name, path)
                        out.diagnostic("other", "medium", f"{x.name} failed: {type(e).__name__}", [file_id(path)], other="extraction_failed")
                    rows += out.rows
            yield batch_of(rows, schema)

    return files.where("content is not null").select("path", "language_hint", "content_hash", "content").mapInArrow(each, ROWS)


def inventory(files: DataFrame) -> DataFrame:
    """A ``file`` entity and a ``file_discovered`` fact of every file, by expressions alone."""
    from graphloom.functions.text import entity_id, fnv1a64

    key = F.concat(F.lit("file://"), "path")
    name = F.substring_index("path", "/", -1)
    base = files.select("path", "language_hint", "content_hash", key.alias("stable_key"), entity_id("ent", key).alias("file"), name.alias("name"))
    payload = F.to_json(F.struct("content_hash", "language_hint"))
    e = base.select(F.lit("entities").alias("table"), F.col("file").alias("id"), "stable_key", F.lit("file").alias("kind"), "name", "path", F.col("language_hint").alias("language"), F.array().cast("array<string>").alias("aliases"), payload.alias("payload"), F.lit("file").alias("extractor"))
    f = base.select(F.lit("facts").alias("table"), F.concat(F.lit("fact_"), fnv1a64(F.concat_ws("\0", F.lit("file_discovered"), "stable_key"))).alias("id"), F.lit("file_discovered").alias("kind"), "path", F.col("file").alias("subject"), payload.alias("value"), F.lit("file").alias("extractor"), F.lit(1.0).cast("float").alias("confidence"))
    return e.unionByName(f, allowMissingColumns=True)


def tables(rows: DataFrame, files: DataFrame, snapshot: str) -> KnowledgeGraph:
    """The canonical tables of extracted rows: entities merged by id, facts and diagnostics once for each id."""
    snap = F.lit(snapshot).alias("snapshot")
    owner = F.array(F.struct(F.col("path").alias("source_file"))).alias("ownership")
    one = F.struct(F.col("path").alias("source_file"), "line_start", "line_end", F.col("extractor"), F.lit(None).cast("string").alias("commit_hash"), F.coalesce("confidence", F.lit(1.0).cast("float")).alias("confidence"), F.lit("verified").alias("status"))
    evidence = F.array(one).cast(EVIDENCE).alias("evidence")
    e = rows.where("table = 'entities'").select(snap, "id", "stable_key", "kind", "kind_other", "name", "title", F.struct("path", "line_start", "line_end").alias("source"), "language", "aliases", owner, "payload", F.struct("path", "extractor", "line_start").alias("seq"))
    f = rows.where("table = 'facts'").select(snap, "id", "kind", "kind_other", "subject", "object", "value", evidence, owner, "extractor", "confidence").dropDuplicates(["id"])
    d = rows.where("table = 'diagnostics'").select(snap, "id", "kind", "kind_other", "severity", F.lit("open").alias("status"), F.col("name").alias("title"), "message", F.col("aliases").alias("entities"), evidence, owner, F.lit("{}").alias("payload")).dropDuplicates(["id"])
    spark = rows.sparkSession
    return KnowledgeGraph(conform(merge_entities(e), "entities"), conform(f, "facts"), KnowledgeGraph.empty(spark).relations, conform(d, "diagnostics"), conform(file_state(files, snapshot), "file_state"))


def extract(files: DataFrame, snapshot: str, extractors: list[Extractor] | None = None) -> KnowledgeGraph:
    """Entities, facts and diagnostics of ``files``; no relations yet."""
    from graphloom.sources.extractors import EXTRACTORS

    rows = run(files, list(EXTRACTORS) if extractors is None else extractors)
    rows = stage(rows, "extracted").unionByName(inventory(files), allowMissingColumns=True)
    return tables(rows, files, snapshot)
