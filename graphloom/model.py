"""The canonical tables, and a snapshot of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OWNERSHIP = "array<struct<source_file:string>>"
EVIDENCE = "array<struct<source_file:string,line_start:int,line_end:int,extractor:string,commit_hash:string,confidence:float,status:string>>"
ENTITIES = (
    "snapshot string, id string, stable_key string, kind string, kind_other string, name string, title string, "
    f"source struct<path:string,line_start:int,line_end:int>, language string, aliases array<string>, ownership {OWNERSHIP}, payload string"
)
FACTS = f"snapshot string, id string, kind string, kind_other string, subject string, object string, value string, evidence {EVIDENCE}, ownership {OWNERSHIP}, extractor string, confidence float"
RELATIONS = f"snapshot string, id string, kind string, kind_other string, src string, dst string, status string, confidence float, evidence {EVIDENCE}, ownership {OWNERSHIP}, payload string"
DIAGNOSTICS = (
    "snapshot string, id string, kind string, kind_other string, severity string, status string, title string, message string, "
    f"entities array<string>, evidence {EVIDENCE}, ownership {OWNERSHIP}, suggested_fix string, payload string"
)
FILE_STATE = "snapshot string, path string, content_hash string, language_hint string"
SOURCES = "path string, language_hint string, content_hash string, content string"
TABLES = {"entities": ENTITIES, "facts": FACTS, "relations": RELATIONS, "diagnostics": DIAGNOSTICS, "file_state": FILE_STATE}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])  # type: ignore[return-value]


@dataclass(frozen=True)
class KnowledgeGraph:
    """The tables of one snapshot. No operator changes them; an operator returns a DataFrame or another graph."""

    entities: DataFrame
    facts: DataFrame
    relations: DataFrame
    diagnostics: DataFrame
    file_state: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> KnowledgeGraph:
        return KnowledgeGraph(**{t: spark.createDataFrame([], s) for t, s in TABLES.items()})

    @property
    def ends(self) -> DataFrame:
        """(src, dst) of relations; a pair may come more often than there are relations of it."""
        return self.relations.select("src", "dst")

    def with_tables(self, **tables: DataFrame) -> KnowledgeGraph:
        return replace(self, **tables)


def conform(df: DataFrame, table: str) -> DataFrame:
    """A DataFrame with a table's columns in order and of its types; missing ones are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)))
