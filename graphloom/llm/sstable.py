"""Token ids in sorted-string-table shards.

A shard is a file of documents in ascending key order:

    data blocks   entries (shared, unshared, value length as varints; key suffix; value), the key without
                  the prefix it shares with the entry before; a block starts anew. zstd-compressed.
    index         for each block: its first key, file offset, stored length, entries
    Bloom filter  10 bits a key, 7 probes by double hashing of XXH64
    footer        fixed size: places of index and filter, entries, tokens, id width, checksum, magic

A key is the id's eight bytes, big-endian with the sign flipped, so that byte order is numeric order; a
null id has the empty key and comes first. A value is the token ids, two or four bytes each.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, byte_texts, filesystem, fresh_dir, shuffle_parts, slices, table
from graphloom.llm.tokenizing import path_of, word_ids

MAGIC = b"GLSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK = 64 << 10
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MANIFEST = "path string, part int, first_id long, last_id long, docs long, tokens long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([(xxhash.xxh64_intdigest(k, 1), xxhash.xxh64_intdigest(k, 2) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return (h[:, :1] + np.arange(7, dtype=np.uint64) * h[:, 1:]) % np.uint64(bits)


class Writer:
    """Writes entries, which must come in ascending key order, to an open stream."""

    def __init__(self, stream, width: int) -> None:
        self.stream, self.width = stream, width
        self.offset = self.entries = self.tokens = 0
        self.block, self.size, self.in_block = [], 0, 0
        self.last, self.first = b"", b""
        self.index, self.keys = [], []
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        piece = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [piece, value]
        self.size += len(piece) + len(value)
        self.in_block += 1
        self.entries += 1
        self.tokens += len(value) // self.width
        self.keys.append(key)
        self.last = key
        if self.size >= BLOCK:
            self.flush()

    def _write(self, data: bytes) -> int:
        self.stream.write(data)
        self.offset += len(data)
        return self.offset - len(data)

    def flush(self) -> None:
        if self.in_block:
            data = self.packer.compress(b"".join(self.block))
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QQQ", self._write(data), len(data), self.in_block))
            self.block, self.size, self.in_block = [], 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * 10 // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for at in range(0, len(self.keys), 100_000):
            bloom[_probes(self.keys[at : at + 100_000], bits).ravel().astype(np.int64)] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        at_index, at_bloom = self._write(index), self._write(bloom)
        check = zlib.crc32(bloom, zlib.crc32(index))
        self._write(FOOTER.pack(at_index, len(index), at_bloom, len(bloom), self.entries, self.tokens, self.width, check, MAGIC))


class Reader:
    """Reads a shard: whole and in order, or one key by Bloom filter and binary search of the index."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(file.size() - FOOTER.size)
        at_index, n_index, at_bloom, n_bloom, self.entries, self.tokens, self.width, check, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at_index)
        index, self.bloom = file.read(n_index), file.read(n_bloom)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != check:
            raise ValueError("index or filter is damaged")
        self.first, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.first.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQ", index, at + n))
            at += n + 24

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length, n = self.blocks[k]
        self.file.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(length))
        at, key = 0, b""
        for _ in range(n):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every document of this id (more than one if rows are repeated)."""
        key = key_of(doc_id)
        bits = np.frombuffer(self.bloom, np.uint8)
        probes = _probes([key], len(self.bloom) * 8)[0].astype(np.int64)
        if not self.entries or not (bits[probes >> 3] >> (probes & 7) & 1).all():
            return []
        out, k = [], max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.blocks) and self.first[k] <= key:
            out += [self.ids(v).copy() for x, v in self._block(k) if x == key]
            k += 1
        return out


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode whole texts and write shards of ascending id ranges; a table with a row for each shard written.

    A file's name is new for every attempt of a task and only the attempt that succeeds reports it, so
    repeated or speculative tasks leave at most files that nothing refers to.
    """
    bound_batches(docs.sparkSession)
    n = shards or shuffle_parts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, writer, ends = word_ids(path_of(vocabulary)), None, []
        fs, base = filesystem(folder)
        path = f"{base}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
        end = end_id.to_bytes(cache.width, "little")
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer, ends = Writer(fs.open_output_stream(path), cache.width), [ids[0]]
            for doc_id, text in zip(ids, byte_texts(batch), strict=True):
                writer.add(key_of(doc_id), cache.encode(text) + end)
            ends[1:] = [ids[-1]]
        if writer is not None:
            writer.close()
            writer.stream.close()
            row = [path, TaskContext.get().partitionId(), *ends, writer.entries, writer.tokens]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["path", "part", "first_id", "last_id", "docs", "tokens"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, MANIFEST)


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    base, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        rows.append((m["path"], base))
        base += m["tokens"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                with fs.open_input_file(path) as f:
                    reader, found = Reader(f), []
                    for key, value in reader:
                        ids = reader.ids(value)
                        found.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                    if found:
                        yield _rows(found)

    return spark.createDataFrame(rows, "path string, start long").repartition(len(rows)).mapInArrow(run, out)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards and read them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty: the end id alone. Repeated ids are separate entries, ordered by text; null
    ids come first. An empty table writes no shard. Columns but doc_id and text are ignored. The
    driver sees one manifest row for each shard, never one for each document.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "sst")
    return read_shards(spark, folder, write_shards(docs, folder, vocabulary, end_id, shards).collect())


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as shards and read back: doc_id, start, n_tokens, ids_crc32; see ``encode_documents``
    for null, empty and repeated rows, null ids and empty tables."""
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sstable": op1_sstable}
ORACLE: dict[str, str] = {}
