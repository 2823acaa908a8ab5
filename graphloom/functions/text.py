"""Scalar functions over names, paths and keys. All but FNV-1a are built-in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as 16 hex digits; null gives null."""
    return fnv1a64_bytes(F.encode(text, "UTF-8"))


def fnv1a64_bytes(data: Column) -> Column:
    """FNV-1a of bytes as 16 hex digits; null gives null.

    Built-in expressions have no 64-bit product that wraps around, and one step of theirs a byte takes microseconds, so this runs
    over Arrow batches.
    """
    return F.arrow_udf(fnv_of, "string")(data)


#: Rows of a batch that are hashed byte by byte side by side; of fewer, each is hashed alone.
ABREAST = 32


def fnv_of(data: pa.Array) -> pa.Array:
    """FNV-1a of each of an array's values, a byte of all of them at once: the longest first, so that those not yet done lie in front."""
    data = data.cast(pa.binary())
    if not len(data):
        return pa.array([], pa.string())
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    start, size = ends[:-1][order], size[order]
    h = np.full(len(order), 0xCBF29CE484222325, np.uint64)
    most = int(size[ABREAST - 1]) if len(size) >= ABREAST else 0
    active = np.searchsorted(-size, -np.arange(most), "left")
    for i, n in enumerate(active):
        h[:n] ^= raw[start[:n] + i]
        h[:n] *= np.uint64(0x100000001B3)
    for k in range(int(np.searchsorted(-size, -most, "left"))):
        x = int(h[k])
        for c in raw[start[k] + most : start[k] + size[k]].tobytes():
            x = (x ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h[k] = x
    out = np.empty(len(order), np.uint64)
    out[order] = h
    valid = data.is_valid().to_pylist() if data.null_count else [True] * len(data)
    return pa.array([f"{x:016x}" if v else None for x, v in zip(out.tolist(), valid, strict=True)], pa.string())


def entity_id(prefix: str, stable_key: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), fnv1a64(stable_key))


def relation_id(kind: Column, src_key: Column, dst_key: Column) -> Column:
    return F.concat(F.lit("rel_"), fnv1a64(F.concat_ws("\0", kind, src_key, dst_key)))


def normalized(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def terms(text: Column) -> Column:
    """Sorted distinct lower-case runs of letters and digits."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")))


def slug(text: Column) -> Column:
    """Lower case, ASCII letters and digits kept, other runs one dash, none at the ends; a section if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def source_root(path: Column) -> Column:
    """First folder; first two under crates, apps and docs; the path itself if it has no folder."""
    parts = F.split(path, "/")
    two = parts[0].isin("crates", "apps", "docs")
    return F.when(F.size(parts) < 2, path).when(two, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def anchor(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def static_segment(path: Column) -> Column:
    """The last segment of an API path that is no parameter."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.startswith("{")), F.lit(-1))


def previous_snapshot(snapshot: Column) -> Column:
    """The id whose number at the end is one less, as wide; null if there is none."""
    number = F.regexp_extract(snapshot, r"(\d+)$", 1)
    value = F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999999999999")).cast("bigint")
    return F.when(value > 0, F.concat(F.regexp_extract(snapshot, r"^(.*?)\d+$", 1), F.lpad((value - 1).cast("string"), F.length(number), "0")))


def resolved_path(folder: Column, relative: Column) -> Column:
    """A relative path seen from a folder, without . and .. segments."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), relative), "/"), lambda x: ~x.isin("", "."))
    step = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def parent_name(qualified: Column, separator: str = "::") -> Column:
    """A qualified name without its last part; null if it has one part."""
    at = F.instr(F.reverse(qualified), separator[::-1])
    return F.when(at > 0, F.substring(qualified, F.lit(1), F.length(qualified) - at - F.lit(len(separator) - 1)))


def named_type(graph_type: Column) -> Column:
    return F.regexp_replace(graph_type, r"[\[\]!\s]", "")


def module_aliases(module: Column) -> Column:
    return F.array_distinct(F.array(module, F.replace(module, F.lit("-"), F.lit("_")), F.replace(module, F.lit("_"), F.lit("-"))))


def key_parts(stable_key: Column) -> Column:
    """(scheme, segments) of a stable key."""
    return F.struct(F.regexp_extract(stable_key, r"^([a-z_-]+)://", 1).alias("scheme"), F.split(F.regexp_replace(stable_key, r"^[a-z_-]+://", ""), "/").alias("segments"))


def xml_escaped(text: Column) -> Column:
    out = text
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def classified_path(path: Column) -> Column:
    """test, contract, source, docs or other, by prefix, suffix and part."""
    return (
        F.when(path.contains("/tests/") | path.startswith("tests/") | path.rlike(r"(_test|\.test|\.spec)\.[a-z]+$"), "test")
        .when(path.contains("/contracts/"), "contract")
        .when(path.contains("/src/") | path.startswith("src/"), "source")
        .when(path.startswith("docs/") | path.endswith(".md"), "docs")
        .otherwise("other")
    )
