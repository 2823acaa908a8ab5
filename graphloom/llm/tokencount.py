"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent ones, then worker caches."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table
from graphloom.llm.tokenizing import LONGEST_CACHED, PIECE, load, path_of, piece_lengths

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens of the broadcast table. It holds at most FREQUENT * (LONGEST_CACHED * 4 + 1) bytes.
FREQUENT = 20_000
#: Documents that the table is chosen from, about. Results do not depend on it: a miss is encoded.
SAMPLED = 2_000


def pack(lengths: dict[str, int]) -> bytes:
    """Compact table: a byte for each count, then the pre-tokens, null-separated (never with a null inside)."""
    kept = {k: v for k, v in lengths.items() if v < 256 and "\0" not in k}
    return zlib.compress(len(kept).to_bytes(4, "little") + bytes(kept.values()) + "\0".join(kept).encode())


def unpack(blob: bytes) -> dict[str, int]:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return dict(zip(raw[4 + n :].decode().split("\0"), raw[4 : 4 + n], strict=True)) if n else {}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(x for x in PIECE.findall(text or "") if len(x) <= LONGEST_CACHED)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])


def frequent_lengths(docs: DataFrame, path: str, most: int = FREQUENT, sampled: int = SAMPLED) -> bytes:
    """Packed token counts of the most frequent pre-tokens of about ``sampled`` documents."""
    share = min(1.0, sampled / max(1, docs.count()))
    seen = docs.select("text").sample(fraction=share, seed=7).mapInArrow(_frequencies, "piece string, n long")
    top = seen.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most).select("piece").toPandas()
    tokenizer = load(path)
    pieces = list(top["piece"])
    return pack({x: len(e.ids) for x, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    ``vocabulary`` names a tokenizers file. Counts are those of the library without begin, end or added
    special tokens; special strings inside a text are read as the library does by default. Null texts
    count as empty (0 bytes, 0 tokens). Repeated rows and null ids are kept; other columns are ignored.
    """
    path = path_of(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    tag = f"{vocabulary}-{shared.id if hasattr(shared, 'id') else id(shared)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = piece_lengths(path_of(vocabulary), unpack(shared.value), tag)
        for batch in slices(batches):
            text = batch.column("text")
            n = np.array([lengths.count(x) if x else 0 for x in text.to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document: doc_id, n_bytes, n_tokens, over_limit; see ``token_counts`` for null texts and ids, repeated
    rows and empty tables."""
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
