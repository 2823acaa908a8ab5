"""What an index is built with: sources, extractors, linkers, checkers and projectors, by name."""

from __future__ import annotations

import json
import subprocess
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphloom.model import KnowledgeGraph
from graphloom.operators.check import CHECKERS
from graphloom.operators.link import LINKERS
from graphloom.sources.extract import COLUMNS, ROWS, Extractor
from graphloom.sources.extractors import EXTRACTORS
from graphloom.sources.files import scan

Rule = Callable[[KnowledgeGraph], DataFrame]


class SourceProvider(ABC):
    """Files as rows (path, language_hint, content_hash, content)."""

    @abstractmethod
    def files(self, spark: SparkSession) -> DataFrame: ...


class Projector(ABC):
    """Writes a view of a snapshot somewhere."""

    @abstractmethod
    def project(self, g: KnowledgeGraph, snapshot: str) -> None: ...


class EmbeddingProvider(ABC):
    """Vectors (id, embedding) of texts (id, text)."""

    @abstractmethod
    def embed(self, texts: DataFrame) -> DataFrame: ...


class VectorIndex(ABC):
    """Nearest rows to queries."""

    @abstractmethod
    def nearest(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Folder(SourceProvider):
    root: str

    def files(self, spark: SparkSession) -> DataFrame:
        return scan(spark, self.root)


@dataclass
class Registry:
    extractors: dict[str, Extractor] = field(default_factory=lambda: {x.name: x for x in EXTRACTORS})
    linkers: dict[str, list[Rule]] = field(default_factory=lambda: dict(LINKERS))
    checkers: dict[str, list[Rule]] = field(default_factory=lambda: dict(CHECKERS))
    projectors: dict[str, Projector] = field(default_factory=dict)

    def only(self, extractors: list[str] | None = None, linkers: list[str] | None = None, checkers: list[str] | None = None) -> Registry:
        pick = lambda have, names: have if names is None else {n: have[n] for n in names}
        return Registry(pick(self.extractors, extractors), pick(self.linkers, linkers), pick(self.checkers, checkers), self.projectors)


MOST_INPUT, MOST_OUTPUT, SECONDS = 8 << 20, 8 << 20, 30


def external(files: DataFrame, command: list[str], name: str, enabled: bool = False, seconds: float = SECONDS) -> DataFrame:
    """Extracted rows of a child process that gets each file as one JSON object and answers with {"rows": [...]}.

    Off unless enabled. Output that is too long, late or no JSON, and inputs that are too long, give a diagnostic for the file.
    """
    if not enabled:
        raise PermissionError("external extractors are off")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, hint, digest, text in b.itertuples(index=False):
                said = json.dumps({"path": path, "language_hint": hint, "content_hash": digest, "content": text}).encode()
                try:
                    if len(said) > MOST_INPUT:
                        raise ValueError("input too long")
                    got = subprocess.run(command, input=said, capture_output=True, timeout=seconds, check=True).stdout
                    if len(got) > MOST_OUTPUT:
                        raise ValueError("output too long")
                    found = json.loads(got)["rows"]
                    rows += [dict.fromkeys(COLUMNS) | {k: v for k, v in r.items() if k in COLUMNS} | {"path": path, "extractor": name} for r in found]
                except (ValueError, KeyError, TypeError, OSError, subprocess.SubprocessError) as e:
                    rows.append(dict.fromkeys(COLUMNS) | {"table": "diagnostics", "id": f"diag_external_{name}_{path}", "kind": "other", "kind_other": "extraction_failed", "severity": "medium", "name": "external extractor failed", "message": type(e).__name__, "aliases": [], "path": path, "extractor": name, "confidence": 1.0})
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.where("content is not null").select("path", "language_hint", "content_hash", "content").mapInPandas(each, ROWS)
