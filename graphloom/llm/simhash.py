"""Near duplicates: SimHash fingerprints, Golay-code keys, connected components.

Two fingerprints within two differing bits agree exactly on one of three segments (pigeonhole), and
differ in at most two bits on the next segment. The perfect binary Golay code (23, 12) decodes every
23-bit word to one codeword. The key set of a word is what the word and its 23 neighbours decode to
(one or six codewords): words at distance two have a neighbour in common, hence a key. So
(exact segment, codeword of the next segment) is a complete set of join keys, 1 or 6 for each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bloom
from graphloom.llm.common import byte_texts, slices, stage, table
from graphloom.llm.components import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys held by more fingerprints are solved by one-bit variants instead of pairs.
MOST_PAIRED = 8
_ONES = np.uint64(0x0101010101010101)
_TABLE: list[np.ndarray] = []


def golay_table() -> np.ndarray:
    """Codeword index (12 bits) that each 23-bit word decodes to."""
    if not _TABLE:
        words = np.zeros(4096, np.uint32)
        for i in range(12):
            words ^= np.where(np.arange(4096) >> i & 1, np.uint32(0xC75 << i), np.uint32(0))
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
        out = np.empty(1 << 23, np.uint16)
        for e in errors:
            out[words ^ np.uint32(e)] = np.arange(4096)
        _TABLE.append(out)
    return _TABLE[0]


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every distinct key of every 23-bit word."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    keys = np.sort(golay_table()[words.astype(np.uint32)[:, None] ^ flips], axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def fingerprint_of(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of rows whose hashes lie side by side: bit set if set in over half of them."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.nonzero(lengths)[0]
    if not len(full):
        return out
    # Sums of up to 255 hashes fit in bytes: cut rows to such pieces first.
    pieces = -(-lengths[full] // 255)
    first = np.repeat(starts[full] - np.concatenate([[0], np.cumsum(pieces)[:-1]]) * 255, pieces) + np.arange(pieces.sum()) * 255
    rows = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    for k in range(8):
        part = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, first).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(part, rows, axis=0, dtype=np.int64) * 2 > lengths[full][:, None]
        for j in range(8):
            out[full] |= bits[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lengths, parts = [], []
        for text in byte_texts(batch):
            w = text.lower().split()
            shingles = [b" ".join(w)] if 0 < len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
            lengths.append(n := max(len(w) - words + 1, 1 if w else 0))
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))
        lengths = np.array(lengths)
        fp = fingerprint_of(np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(fp.view(np.int64))], [*own, "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): SimHash of the ``words``-word shingles of each whole text, repeats included.

    Fewer words are one shingle; no words (or null) give 0.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = whole.slice(at, 20_000)
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            bits = fp.view(np.uint64)
            for k in range(3):
                row, code = golay_keys(_segment(bits, (k + 1) % 3))
                key = (np.uint64(k) << np.uint64(34)) | (_segment(bits, k)[row] << np.uint64(12)) | code.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row]), pa.array(rep[row])], ["key", "fp", "rep"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            batch = whole.slice(at, 20_000)
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            v = fp.view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel().view(np.int64)), pa.array(np.repeat(rep, 65))], ["key", "rep"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives that join all fingerprints (fp, rep) within two bits.

    A key held by at most MOST_PAIRED fingerprints is paired and verified. Fingerprints under fuller
    keys emit their 64 one-bit variants and themselves: those that share one are all within two bits of each
    other, and exactly those within two bits share one, so a star to the smallest replaces the pairs.
    """
    keys = distinct.where("rep is not null").mapInArrow(_keys, "key long, fp long, rep long")
    keys = stage(keys, "golay")
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keys.join(full, "key"), "shared")
    cool = shared.where(F.col("n") <= MOST_PAIRED).select("key", "fp", "rep")
    other = cool.toDF("key", "fp2", "rep2")
    pairs = cool.join(other, "key").where((F.col("rep") > F.col("rep2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2))
    hot = shared.where(F.col("n") > MOST_PAIRED).select("fp", "rep").distinct()
    near = hot.mapInArrow(_variants, "key long, rep long")
    least = near.groupBy("key").agg(F.min("rep").alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m")
    stars = near.join(least, "key").where("rep <> m")
    return pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).union(stars.select(F.col("rep").alias("a"), F.col("m").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    component_id is the smallest doc_id whose fingerprint can be reached over links of two or fewer bits.
    Empty and null texts have fingerprint zero and are linked like any other. Rows with a null
    doc_id get a row, but are no smallest id; where only such rows have a fingerprint, component_id
    is null. Repeated rows are repeated in the result. Other columns of ``docs`` are ignored. An empty table gives none.
    """
    fps = stage(fingerprints(docs, words), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct))
    classes = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each group of linked fingerprints, with all its columns: that of the smallest doc_id.

    Groups are of fingerprints, so ids may repeat or be null: rows without an id come last, and of different texts of
    one id that of the smallest hash is first. Of rows alike in both id and text one stays. Texts do not move: rows that a
    filter of fixed size tells to be neither dropped nor repeated stay where they are, and the others alone are joined.
    """
    # Columns go by their place on the way, so that none can clash with another.
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = own[names.index("doc_id")], own[names.index("text")]
    keyed = docs.toDF(*own).withColumns({"id": F.col(doc_id).cast("long"), "text_hash": F.xxhash64(text, F.col(text).isNull())})
    fps = stage(keyed.select("id", F.col(text).alias("text"), "text_hash").mapInArrow(lambda it: _fingerprints(it, words), "id long, text_hash long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("first")
    distinct = stage(fps.groupBy("fp").agg(first), "distinct")
    # Ids may be shared by fingerprints or missing, so a fingerprint is its own representative.
    roots = components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    groups = distinct.join(roots, distinct["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = groups.select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), F.lit(True).alias("stays"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])
    seen = fps.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    marked = seen.join(kept, same(seen, kept), "left").where("stays is null or n > 1")
    marked = stage(marked.select(seen["id"], seen["text_hash"], F.coalesce("stays", F.lit(False)).alias("stays")), "marked")
    key = F.xxhash64("id", "text_hash")
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(marked.select(key.alias("key"))))

    @F.pandas_udf("boolean")
    def met(key):
        import pandas as pd

        return pd.Series(bloom.inside(bits.value, key.to_numpy(np.int64)))

    asked = keyed.withColumn("met", met(key))
    some = asked.where("met")
    out = asked.where("not met").unionByName(some.join(marked, same(some, marked), "left_anti"))
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(some.join(repeated, same(some, repeated), "left_semi").dropDuplicates(["id", "text_hash"]))
    return out.select(*own).toDF(*names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint, component_id; see ``near_duplicates`` for null, empty and
    repeated rows, null ids and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
