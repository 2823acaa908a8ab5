"""Kinds, severities and their renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
#: Relation kinds along which a change travels from target to source, and from source to target.
BACKWARD = ("calls", "imports", "implemented_by", "documents", "documents_api", "documents_operation", "schema_for_request", "schema_for_response", "contains")
FORWARD = ("tested_by", "covered_by_test", "defines")
WEIGHTS = {
    90: ("calls", "implemented_by", "implements", "schema_for_request", "schema_for_response", "requires_auth", "requires_permission", "queries_table"),
    80: ("imports", "tested_by", "covered_by_test", "declared_in_openapi", "changed_with"),
    60: ("documents", "documents_api", "documents_operation", "uses_env", "example_for"),
    30: ("contains", "defines"),
    75: ("other",),
}


def display_kind(style: str = "graph", kind: str = "kind", other: str = "kind_other") -> Column:
    """A kind as ``graph`` (the open value itself), ``overview`` ('unknown'), ``query`` ('other'), ``debug`` or ``serde``."""
    k, o = F.col(kind), F.col(other)
    if style == "graph":
        return F.coalesce(o, k)
    if style == "overview":
        return F.when(o.isNotNull(), F.lit("unknown")).otherwise(k)
    if style == "query":
        return F.when(o.isNotNull(), F.lit("other")).otherwise(k)
    if style == "debug":
        return F.when(o.isNotNull(), F.concat(F.lit('Other("'), o, F.lit('")'))).otherwise(k)
    if style == "serde":
        return F.when(o.isNotNull(), F.to_json(F.struct(o.alias("other")))).otherwise(k)
    raise ValueError(style)


def severity_rank(column: str = "severity") -> Column:
    """0 for critical to 3 for low; 4 for anything else."""
    out = F.lit(4)
    for rank, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def relation_weight(column: str = "kind") -> Column:
    out = F.lit(50)
    for weight, kinds in WEIGHTS.items():
        out = F.when(F.col(column).isin(*kinds), weight).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down, 100 at most; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(part * 100 / F.nullif(whole, F.lit(0))))).cast("int")


def tenths(confidence: Column) -> Column:
    """Ten times a confidence clamped to 0..1, rounded half away from zero."""
    return F.round(F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0)) * 10).cast("long")
