"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting moves packed arrays, not rows: a task sorts and sums what it has read and sends each part, a
range of keys, one compressed block. Three rounds make the model, all in the shared folder:

1. vocabulary: sorted XXH64 of words with counts; a word's number is its place over all parts;
2. bigrams: 32-bit numbers of both words in one 64-bit key, multiplied by an odd constant (which can be undone), so
   that no word's bigrams meet in one part; sorted with counts;
3. contexts, dense by word number: total, followers seen once, twice, more often, and words it follows.

Scoring maps the files and looks up a batch's distinct keys in order. The order of the model is two, so that
a key is exact and the arrays stay near the size of the text.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import byte_texts, filesystem, fresh_dir, id_crc, shuffle_parts, slices, table

END = np.uint64(0x5DEECE66D1234567)
ODD = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOW = np.uint64(0xFFFFFFFF)
#: Tokens that a task counts before it sends what it has.
HELD = 4_000_000
BLOCK = "part int, keys binary, values binary"
FILE = "part int, path string, n long, total long, over long, counts array<long>"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def pack(x: np.ndarray) -> bytes:
    """An array with its bytes of equal weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.dtype.str.encode() + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:3].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=3).reshape(kind.itemsize, (len(raw) - 3) // kind.itemsize).T).view(kind).ravel()


def delta(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of 64-bit keys, of ``parts`` equal ones, that each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words and its end, side by side; tokens of each text)."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    out = np.empty(int(n.sum()) + len(n), np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(n.sum()))
    out[ends] = END
    return out, n + 1


def _sent(keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(keys, return_counts=True)
    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.nonzero(np.diff(cuts))[0]:
        own = slice(cuts[p], cuts[p + 1])
        yield _row(BLOCK_NAMES, int(p), pack(delta(keys[own])), pack(counts[own].astype("<u4")))


BLOCK_NAMES = ["part", "keys", "values"]


def _row(names: list[str], part: int, *blobs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names)


def _counted(batches: Iterator[pa.RecordBatch], parts: int, keys_of) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in slices(batches):
        held.append(keys_of(*tokens(byte_texts(batch))))
        n += len(held[-1])
        if n > HELD:
            yield from _sent(np.concatenate(held), parts)
            held, n = [], 0
    if n:
        yield from _sent(np.concatenate(held), parts)


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in t.column("keys").to_pylist()])
    return summed(keys, np.concatenate([unpack(x) for x in t.column("values").to_pylist()]).astype(np.int64))


def _written(folder: str, part: int, arrays: list[np.ndarray], n: int, total: int, over: int, counts: list[int]) -> pa.Table:
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/part-{part:05d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(path) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    cols = [(part, pa.int32()), (path, pa.string()), (n, pa.int64()), (total, pa.int64()), (over, pa.int64()), (counts, pa.list_(pa.int64()))]
    return pa.table({name: pa.array([x], t) for name, (x, t) in zip(("part", "path", "n", "total", "over", "counts"), cols, strict=True)})


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


_MAPPED: dict[str, list[np.ndarray]] = {}


def mapped(folder: str, path: str, layout: list[tuple[str, int]]) -> list[np.ndarray]:
    """Arrays of a file, memory-mapped: in the shared folder itself or, if that is a remote store, from a copy of the worker's
    own, which has no name any more once it is mapped and so goes with the worker."""
    from pyarrow import fs as pafs

    fs, _ = filesystem(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return _arrays(path, layout)
    if path not in _MAPPED:
        with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile() as out:
            while data := f.read(1 << 20):
                out.write(data)
            out.flush()
            _MAPPED[path] = _arrays(out.name, layout)
    return _MAPPED[path]


def _arrays(local: str, layout: list[tuple[str, int]]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in layout:
        out.append(np.memmap(local, kind, "r", at, (n,)) if n else np.zeros(0, kind))
        at += np.dtype(kind).itemsize * n
    return out


@dataclass
class Model:
    folder: str
    parts: int
    words: list[tuple[int, str, int, int]]  # part, path, entries, number of the first
    bigrams: list[tuple[int, str, int, int]]  # part, path, entries, entries counted over 254
    contexts: list[tuple[int, str, int]]  # range, path, words
    size: int  # distinct tokens
    total: int  # tokens
    pairs: int  # distinct bigrams
    width: int  # words of a range
    discounts: list[float]  # of bigrams seen once, twice, more often
    lower: list[float]  # of words that follow one word, two, more
    lower_rest: float  # share of the lower order left to the uniform law

    def open(self) -> Opened:
        return Opened(self)


class Opened:
    """A worker's maps of the model's files."""

    def __init__(self, m: Model) -> None:
        self.m = m
        self.words = {p: (mapped(m.folder, path, [("<u8", n), ("<i8", n)]), base) for p, path, n, base in m.words}
        self.bigrams = {p: mapped(m.folder, path, [("<u8", n), ("<u8", over), ("<u8", over), ("u1", n)]) for p, path, n, over in m.bigrams}
        self.contexts = {p: mapped(m.folder, path, [("<i8", n)] * 5) for p, path, n in m.contexts}

    def _each(self, keys: np.ndarray, parts: np.ndarray, tables: dict) -> Iterator[tuple[slice, object]]:
        cuts = np.searchsorted(parts, np.arange(self.m.parts + 1))
        for p in np.nonzero(np.diff(cuts))[0]:
            if int(p) in tables:
                yield slice(cuts[p], cuts[p + 1]), tables[int(p)]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number or -1, count) of each hash."""
        keys, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for own, ((known, counts), base) in self._each(keys, part_of(keys, self.m.parts), self.words):
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            hit = known[at] == keys[own]
            number[own] = np.where(hit, base + at, -1)
            count[own] = np.where(hit, counts[at], 0)
        return number[back], count[back]

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, back = np.unique(pair_keys(first, second), return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        for own, (known, big, big_count, small) in self._each(keys, part_of(keys, self.m.parts), self.bigrams):
            at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
            c = np.where(known[at] == keys[own], small[at], 0).astype(np.int64)
            if (large := c == 255).any():
                c[large] = big_count[np.searchsorted(big, keys[own][large])]
            count[own] = c
        return count[back]

    def statistics(self, numbers: np.ndarray) -> list[np.ndarray]:
        """Context total, followers seen once, twice, more often, and words followed, of each number."""
        keys, back = np.unique(numbers, return_inverse=True)
        out = [np.zeros(len(keys), np.float64) for _ in range(5)]
        for own, columns in self._each(keys, keys // self.m.width, self.contexts):
            for o, c in zip(out, columns, strict=True):
                o[own] = c[keys[own] % self.m.width]
        return [o[back] for o in out]

    def score(self, hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """(known tokens, log10 probability by add-one counts, by the model) of each text."""
        m = self.m
        number, count = self.numbers(hashes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.log10((count + 1) / (m.total + m.size + 1))
        before = np.concatenate([[m.size], number[:-1]])
        before[starts] = m.size  # a text begins after a mark that is no token
        lower = np.full(len(number), m.lower_rest / (m.size + 1))
        at = np.nonzero(number >= 0)[0]
        if len(at):
            follows = self.statistics(number[at])[4]
            lower[at] += np.maximum(follows - discount(m.lower, follows), 0) / m.pairs
        p = lower.copy()
        ctx = np.nonzero(before >= 0)[0]
        if len(ctx) and m.size:
            total, once, twice, more, _ = self.statistics(before[ctx])
            seen, total, once, twice, more = ctx[total > 0], total[total > 0], once[total > 0], twice[total > 0], more[total > 0]
            rest = (m.discounts[0] * once + m.discounts[1] * twice + m.discounts[2] * more) / total
            c = np.zeros(len(seen), np.int64)
            both = number[seen] >= 0
            c[both] = self.pair_counts(before[seen[both]], number[seen[both]])
            p[seen] = np.maximum(c - discount(m.discounts, c), 0) / total + rest * lower[seen]
        return [np.add.reduceat(number >= 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]


def discount(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) * ODD


def modified_discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's estimates from how many are seen once to four times; halves where a count is missing."""
    n1, n2, n3, n4 = n
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _context_blocks(manifest: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    for batch in manifest:
        for path, n, over in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "over")), strict=True):
            keys, big, big_count, small = mapped(folder, path, [("<u8", n), ("<u8", over), ("<u8", over), ("u1", n)])
            pairs = np.asarray(keys) * UNDO
            c = np.asarray(small).astype(np.int64)
            if over:
                c[c == 255] = big_count[np.searchsorted(big, keys[c == 255])]
            first, second = pairs >> np.uint64(32), pairs & LOW
            order = np.argsort(first, kind="stable")
            first, c = first[order], c[order]
            at = np.nonzero(np.concatenate([[True], first[1:] != first[:-1]]))[0]
            columns = [np.add.reduceat(x, at, dtype=np.int64) for x in (c, c == 1, c == 2, c > 2)]
            followed, follows = np.unique(second, return_counts=True)
            for role, ids, values in ((0, first[at], columns), (1, followed, [follows])):
                cuts = np.searchsorted((ids // np.uint64(width)).astype(np.int64), np.arange(int(ids[-1]) // width + 2))
                for r in np.nonzero(np.diff(cuts))[0]:
                    own = slice(cuts[r], cuts[r + 1])
                    data = [pack(v[own].astype("<i8")) for v in values]
                    sizes = np.array([role, *map(len, data)], "<u4").tobytes()
                    yield _row(BLOCK_NAMES, int(r), pack(delta(ids[own])), bytes([len(sizes)]) + sizes + b"".join(data))


def _dense(t: pa.Table, part: int, width: int, folder: str) -> pa.Table:
    out = [np.zeros(width, np.int64) for _ in range(5)]
    for keys, values in zip(t.column("keys").to_pylist(), t.column("values").to_pylist(), strict=True):
        ids = (np.cumsum(unpack(keys), dtype=np.uint64) % np.uint64(width)).astype(np.int64)
        role, *sizes = np.frombuffer(values[1 : 1 + values[0]], "<u4").tolist()
        at = 1 + values[0]
        for k, n in enumerate(sizes):
            out[4 * role + k][ids] += unpack(values[at : at + n])
            at += n
    return _written(folder, part, [o.astype("<i8") for o in out], width, int(out[4].sum()), 0, _counts_of_counts(out[4]) + [int((out[4] > 2).sum())])


def fit(docs: DataFrame, parts: int | None = None) -> Model:
    """Count the model of all whole texts of ``docs``; null texts are empty, one end each.

    The driver sees one row for each part, never one for each word or bigram. Over 2**32 - 1 distinct words are an error.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_parts(spark)
    folder = fresh_dir(spark, "kneserney")
    texts = docs.select("text")

    def words_file(key, t):
        keys, counts = _merged(t)
        return _written(folder, key[0].as_py(), [keys, counts.astype("<i8")], len(keys), int(counts.sum()), 0, [])

    blocks = texts.mapInArrow(lambda it: _counted(it, parts, lambda h, n: h), BLOCK)
    files = sorted(blocks.groupBy("part").applyInArrow(words_file, FILE).collect(), key=lambda r: r["part"])
    bases = np.concatenate([[0], np.cumsum([r["n"] for r in files])]).astype(np.int64).tolist()
    size, total = bases[-1], sum(r["total"] for r in files)
    if size >= (1 << 32) - 1:
        raise ValueError("over 2**32 - 1 distinct words")
    m = Model(folder, parts, [(r["part"], r["path"], r["n"], b) for r, b in zip(files, bases, strict=False)], [], [], size, total, 1, -(-(size + 1) // parts), [0.5, 1.0, 1.5], [0.5, 1.0, 1.5], 1.0)
    if not size:
        return m
    words = spark.sparkContext.broadcast(m)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = words.value.open()

        def keys_of(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
            number, _ = opened.numbers(hashes)
            before = np.concatenate([[opened.m.size], number[:-1]])
            before[np.concatenate([[0], np.cumsum(n)[:-1]])] = opened.m.size
            return pair_keys(before, number)

        return _counted(batches, parts, keys_of)

    def bigram_file(key, t):
        keys, counts = _merged(t)
        big = counts > 254
        arrays = [keys, keys[big], counts[big].astype("<u8"), np.minimum(counts, 255).astype("u1")]
        return _written(folder, key[0].as_py(), arrays, len(keys), int(counts.sum()), int(big.sum()), _counts_of_counts(counts))

    files = texts.mapInArrow(bigrams, BLOCK).groupBy("part").applyInArrow(bigram_file, FILE).collect()
    m.bigrams = [(r["part"], r["path"], r["n"], r["over"]) for r in files]
    m.pairs = sum(r["n"] for r in files)
    m.discounts = modified_discounts([sum(r["counts"][k] for r in files) for k in range(4)])
    listed = spark.createDataFrame([(r["path"], r["n"], r["over"]) for r in files], "path string, n long, over long").repartition(len(files))
    width = m.width
    dense = listed.mapInArrow(lambda it: _context_blocks(it, folder, width), BLOCK).groupBy("part").applyInArrow(lambda key, t: _dense(t, key[0].as_py(), width, folder), FILE).collect()
    m.contexts = [(r["part"], r["path"], r["n"]) for r in dense]
    n = [sum(r["counts"][k] for r in dense) for k in range(5)]
    m.lower = modified_discounts(n[:4])
    m.lower_rest = sum(d * x for d, x in zip(m.lower, (n[0], n[1], n[4]), strict=True)) / m.pairs
    return m


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row's whole text; null texts are empty (one end).

    Scores are log10 probabilities of the text with its end. Repeated rows and null ids are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.value.open()
        for batch in slices(batches):
            hashes, n = tokens(byte_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *map(pa.array, opened.score(hashes, n))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the training ones: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. A null id counts as empty text in held_out; see ``fit`` and ``scores`` for null texts, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 7 == 2
    model = fit(docs.where(~held_out))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op7_kneser_ney": op7_kneser_ney}
ORACLE: dict[str, str] = {}
