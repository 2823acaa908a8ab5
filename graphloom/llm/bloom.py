"""A Bloom filter of fixed size, built in Spark and broadcast: what it does not hold needs no join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (16 MB) with two probes. When it fills up, more rows are joined; results stay exact.
FILTER_BITS = 1 << 27


def probes(keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    return np.stack([k >> np.uint64(37), (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(37)], -1).astype(np.int64)


def inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p = probes(keys)
    return ((bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(-1)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = probes(batch.column("key").to_numpy(zero_copy_only=False)).ravel()
        word, bit = p >> 6, np.uint64(1) << (p & 63).astype(np.uint64)
        order = np.argsort(word, kind="stable")
        word, bit = word[order], bit[order]
        if len(word):
            first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], ["word", "bits"])


def build(keys: DataFrame) -> np.ndarray:
    """Filter of a table's column ``key`` (long, hashed). The driver gets the filter's words, 24 MB at most at any input size."""
    got = keys.select("key").mapInArrow(_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out
