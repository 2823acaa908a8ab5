"""Line deduplication within one edit, by deletion neighbourhoods.

Two lines are alike if they are equal or one substitution, insertion or deletion of a character apart.

1. Every line gets a 128-bit id and four half-line keys. If two lines are one edit apart, the first or the
   second half of the shorter is whole in the longer, so they share a key; the others are settled as exact.
2. Lines of which a key is shared emit a key for each sixteenth left out: an edit is within one of them, so lines
   one edit apart share one of these too, and few others do.
3. Lines left emit their deletion neighbourhood as hashed keys, for each place i the line
   without character i: with i (lines under one such key differ by a substitution at i, all of
   them from each other) and without it (to be met by a whole line that is one shorter).
4. For each key the earliest line and the number of lines are enough, so no pair within a key is emitted.
   The earliest like line of each line is verified by edit distance on the texts.

A line occurrence goes if it is not the first of its text, or if an earlier text is one edit apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bloom
from graphloom.llm.common import slices, stage, table

_P = tuple(map(np.uint64, (2147483647, 2147483629, 2147483647, 2147483629)))
_B = (1103515245, 69069069, 48271, 1664525)
#: Characters of a line that are worked on at once, and keys of a batch, about.
CHUNK = 1 << 16
LINES = "doc_id long, row long, line_no int, hi long, lo long, keys array<long>"


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that hold more than white space; line feeds end lines."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x and not x.isspace()]


def line_id(line: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(line)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def half_keys(line: str) -> list[int]:
    """Keys of the halves of a line, as the shorter of a pair and as the longer by one."""
    out = []
    for n in (len(line), len(line) - 1):
        h = n // 2
        for side, part in ((0, line[:h]), (1, line[len(line) - (n - h) :])):
            out.append(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), n * 2 + side) - (1 << 63))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols: list[list] = [[] for _ in range(6)]
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            for no, line in lines_of(text):
                for col, x in zip(cols, (doc, row, no, *line_id(line.encode("utf-8", "surrogatepass")), half_keys(line)), strict=True):
                    col.append(x)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "row", "line_no", "hi", "lo", "keys"])


def shared_filter(distinct: DataFrame) -> np.ndarray:
    """Bloom filter of half-line keys that several lines share."""
    keys = distinct.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return bloom.build(keys)


def _passing(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts of lines with a key in the filter; a text once for each batch."""
    for batch in slices(batches):
        seen = list({line: None for text in batch.column("text").to_pylist() for _, line in lines_of(text)})
        if not seen:
            continue
        inside = bloom.inside(bits, np.array([half_keys(x) for x in seen], np.int64)).any(-1)
        out = [x for x, y in zip(seen, inside, strict=True) if y]
        ids = [line_id(x.encode("utf-8", "surrogatepass")) for x in out]
        yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.array(out, pa.string())], ["hi", "lo", "line"])


def piece_keys(line: str, pieces: int = 16) -> list[int]:
    """Keys of a line without one of its pieces, as the shorter of a pair and as the longer by one."""
    out = []
    for longer in (0, 1):
        n = len(line) - longer
        cuts = [j * n // pieces for j in range(pieces + 1)]
        for j in range(pieces):
            rest = line[: cuts[j]] + line[cuts[j + 1] + longer :]
            out.append(xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass"), n * pieces + j) - (1 << 63))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "line", 2 << 20):
        keys = [sorted(set(piece_keys(x))) for x in batch.column("line").to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), batch.column("hi").take(pa.array(at)), batch.column("lo").take(pa.array(at))], ["key", "hi", "lo"])


_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    """The first CHUNK powers of a base."""
    if k not in _POWERS:
        have = np.ones(1, np.uint64)
        while len(have) < CHUNK:
            have = np.concatenate([have, have * np.uint64(pow(_B[k], len(have), int(_P[k]))) % _P[k]])
        _POWERS[k] = have[:CHUNK]
    return _POWERS[k]


def neighbourhood(line: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of a line, so that any length takes bounded memory: the characters' places; the hashes (a row for each
    of two of 62 bits) of the line without each of them; whether a character is the first of a run of its like (what is
    left does not depend on which of a run goes); and the hashes of the whole line."""

    def terms(at: int):
        c = np.frombuffer(line[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for k in range(4):
            p = _P[k]
            yield c, (c + np.uint64(1)) * (_powers(k)[: len(c)] * np.uint64(pow(_B[k], at, int(p))) % p) % p

    starts = range(0, len(line), CHUNK)
    total = [0] * 4
    for at in starts:
        for k, (_, t) in enumerate(terms(at)):
            total[k] = (total[k] + int(t.sum())) % int(_P[k])
    join = lambda x: np.stack([x[0] << np.uint64(31) | x[1], x[2] << np.uint64(31) | x[3]])
    whole = join([np.array([t], np.uint64) for t in total])
    before, last = [0] * 4, -1
    for at in starts:
        rest = []
        for k, (c, t) in enumerate(terms(at)):
            p = _P[k]
            sums = (np.cumsum(t) + np.uint64(before[k])) % p
            after = (np.uint64(total[k]) + p - sums) % p * np.uint64(pow(_B[k], -1, int(p))) % p
            rest.append((np.concatenate([[np.uint64(before[k])], sums[:-1]]) + after) % p)
            before[k] = int(sums[-1])
        new = np.concatenate([[int(c[0]) != last], c[1:] != c[:-1]])
        last = int(c[-1])
        yield np.arange(at + 1, at + 1 + len(c), dtype=np.uint64), join(rest), new, whole


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a line with its place and id: kind 0 a substitution's, 1 the whole line's, 2 a deletion's."""
    salt = np.uint64(0xD6E8FEB86659FD93)

    def keys_of(line: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(line)
        for place, without, new, whole in neighbourhood(line):
            sub = (without ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            first = [(whole + np.uint64(n)) * salt] if place[0] == 1 else []
            gone = (without[:, new] + np.uint64(n - 1)) * salt
            yield np.concatenate([sub, *first, gone], 1), np.repeat(np.array([0, 1, 2], np.int8), [len(place), len(first), gone.shape[1]])

    for batch in batches:
        held, n_held = [], 0

        def sent(batch=batch):
            keys, kinds, rows = (np.concatenate(x, -1) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(kinds), batch.column("who").take(pa.array(rows))], ["key", "check", "kind", "who"])

        for i, line in enumerate(batch.column("line").to_pylist()):
            for keys, kinds in keys_of(line):
                held.append((keys, kinds, np.full(len(kinds), i)))
                n_held += len(kinds)
                if n_held > CHUNK:
                    yield sent()
                    held, n_held = [], 0
        if held:
            yield sent()


def edits(a: str, b: str) -> int:
    """Edit distance of two lines up to 1; 2 if it is more. Equal stretches are compared whole, so long lines are no matter."""
    if a == b:
        return 0
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return 2
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return 1 if a[low + (len(a) == len(b)) :] == b[low + 1 :] else 2


def _repeated_rows(numbered: DataFrame) -> DataFrame | None:
    """(id, r) of rows that occur again, if there are any."""
    again = numbered.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("r")).agg(F.count("*").alias("n")).where("n > 1").select("id", "r")
    again = stage(again, "again")
    return None if again.isEmpty() else again


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, repeat, near, n_links) of each line of each row that is not blank.

    ``row`` numbers the rows of ``docs``. ``repeat``: an earlier occurrence has the same text.
    ``near``: the text's first occurrence comes after that of a text one edit apart. ``n_links``: texts
    one edit apart. Earlier means a smaller (doc_id, row, line number), null ids last. Lines are compared whole and
    as they are. Null and empty texts have no lines.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    # Rows of one id are told apart by a hash of their text, so that numbers do not depend on how a scan is cut.
    numbered = rows.withColumn("row", F.xxhash64("text"))
    lines = stage(numbered.mapInArrow(_split, LINES), "lines")
    again = _repeated_rows(numbered)
    if again is not None:
        # Equal rows are one document: their lines count once.
        alike = lines["doc_id"].eqNullSafe(again["id"]) & lines["row"].eqNullSafe(again["r"])
        lines = lines.join(again, alike, "left_anti").unionByName(lines.join(again, alike, "left_semi").dropDuplicates(["doc_id", "row", "line_no"]))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line_no")
    distinct = stage(lines.groupBy("hi", "lo").agg(F.min(order).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n")), "texts")
    bits = spark.sparkContext.broadcast(shared_filter(distinct))
    passing = rows.select("text").mapInArrow(lambda it: _passing(it, bits.value), "hi long, lo long, line string")
    halved = stage(passing.groupBy("hi", "lo").agg(F.first("line").alias("line")), "halves")
    pieces = stage(halved.mapInArrow(_pieces, "key long, hi long, lo long"), "pieces")
    both = pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = pieces.join(both, "key", "left_semi").select("hi", "lo").distinct()
    texts = stage(halved.join(left, ["hi", "lo"]).join(distinct.select("hi", "lo", "first"), ["hi", "lo"]), "candidates")
    emitted = texts.select("line", F.struct("first", "hi", "lo").alias("who"))
    who = emitted.schema["who"].dataType.simpleString()
    emitted = stage(emitted.mapInArrow(_emit, f"key long, check long, kind byte, who {who}").withColumn("form", F.least("kind", F.lit(1).cast("byte"))), "neighbourhoods")
    # Only keys that are met matter; counting them moves no place or id.
    name = ["key", "check", "form"]
    shared = emitted.groupBy(*name).agg(F.count_if(F.col("kind") < 2).alias("wholes"), F.count_if(F.col("kind") == 2).alias("gones")).where("wholes > 1 or (form = 1 and wholes + gones > 1)")
    met = stage(emitted.join(shared, name), "met")
    least = met.groupBy(*name).agg(F.min(F.when(F.col("kind") < 2, F.col("who"))).alias("whole"), F.min(F.when(F.col("kind") == 2, F.col("who"))).alias("gone"))
    met = met.join(least, name).select("kind", "wholes", "gones", "whole", "gone", "who.hi", "who.lo")
    partner = F.when(F.col("kind") == 1, F.col("gone")).otherwise(F.col("whole"))
    n = F.when(F.col("kind") == 0, F.col("wholes") - 1).when(F.col("kind") == 1, F.col("gones")).otherwise(F.col("wholes"))
    named = stage(met.select("hi", "lo", n.alias("n"), partner["hi"].alias("hi2"), partner["lo"].alias("lo2")).where("n > 0"), "named")
    own, other = texts.select("hi", "lo", "line", "first"), texts.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("line").alias("line2"), F.col("first").alias("first2"))

    @F.pandas_udf("int")
    def measured(a, b):
        import pandas as pd

        return pd.Series(list(map(edits, a, b)), dtype="int32")

    # All lines under a key are alike if each is like the earliest of them, so each is verified with that one.
    pairs = named.join(own, ["hi", "lo"]).join(other, ["hi2", "lo2"]).withColumn("apart", measured("line", "line2")).where("apart < 2")
    verified = stage(pairs.groupBy("hi", "lo").agg(F.sum("n").alias("n_links"), F.bool_or((F.col("first2") < F.col("first")) & (F.col("apart") == 1)).alias("near")), "verified")
    marks = distinct.select("hi", "lo", "first").join(verified, ["hi", "lo"], "left")
    # Only texts that occur again or have a link differ from "kept, no link".
    special = distinct.where("n > 1").select("hi", "lo").union(verified.select("hi", "lo")).distinct()
    # A table, so that the join below is a plain one, which adaptive execution can split at a common line.
    marks = stage(marks.join(special, ["hi", "lo"], "left_semi"), "marks")
    same = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("row").eqNullSafe(F.col("first.row"))) & (F.col("line_no") == F.col("first.line_no"))
    return lines.drop("keys").join(marks, ["hi", "lo"], "left").select(
        "doc_id", "row", "line_no", (F.col("first").isNotNull() & ~same).alias("repeat"), F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_repeat, n_near, n_kept, n_links) of each document; see ``decisions``.

    n_repeat lines repeat an earlier line; n_near more are first occurrences within one edit of an
    earlier text; n_links adds up, over the document's lines, the texts one edit apart. Rows that are equal in id
    and text are one document. Documents without lines have zeros.
    """
    d = decisions(docs)
    got = d.groupBy("doc_id", "row").agg(
        F.count("*").alias("n_lines"), F.count_if("repeat").alias("n_repeat"), F.count_if(~F.col("repeat") & F.col("near")).alias("n_near"), F.count_if(~F.col("repeat") & ~F.col("near")).alias("n_kept"), F.sum("n_links").alias("n_links")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("r")).distinct()
    names = ["n_lines", "n_repeat", "n_near", "n_kept", "n_links"]
    return rows.join(got, rows["id"].eqNullSafe(got["doc_id"]) & rows["r"].eqNullSafe(got["row"]), "left").select(F.col("id").alias("doc_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of each document without the lines that ``decisions`` drops; blank lines stay, null stays null.

    Rows equal in id and text are one document and give one row. Other columns are ignored.
    """
    d = decisions(docs).where("repeat or near").groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")).toDF("id", "r", "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    if (again := _repeated_rows(rows)) is not None:
        alike = rows["doc_id"].eqNullSafe(again["id"]) & rows["row"].eqNullSafe(again["r"])
        rows = rows.join(again, alike, "left_anti").unionByName(rows.join(again, alike, "left_semi").dropDuplicates(["doc_id", "row"]))
    joined = rows.join(d, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("row").eqNullSafe(F.col("r")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat or nearly repeat earlier ones: doc_id, n_lines, n_repeat, n_near, n_kept, n_links; see
    ``line_report`` for null texts and ids, repeated rows and empty tables."""
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE: dict[str, str] = {}
