"""Benchmark decontamination: a broadcast set of test n-grams scanned over all documents.

Words of benchmark items get numbers; a window is hashed from its words' numbers. A document's words
become numbers through the same table (0: in no item), so only windows without a 0 are hashed and
looked up, and a hit is verified by comparing the numbers themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, byte_texts, release, slices, stage, table

WINDOW = 13
#: Bytes of benchmark text whose windows are broadcast at once. A larger benchmark is cut into groups of
#: items that are scanned for one after the other.
MOST_BYTES = 8 << 20
_WORD_BYTES = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII digits and letters and of non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _rolled(mixed: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of ``n``."""
    out = mixed[: len(mixed) - n + 1].copy()
    for j in range(1, n):
        out = out * _BASE + mixed[j : len(mixed) - n + 1 + j]
    return out


@dataclass
class Windows:
    """Windows of a group of items. All items' word numbers lie side by side; a window is a place in them. By length: the
    windows' hashes (sorted), places and items' numbers: 16 bytes a window."""

    vocabulary: dict[bytes, int]
    names: list[str | None]
    ids: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Windows:
    vocabulary: dict[bytes, int] = {}
    names: list[str | None] = sorted({x for x, _ in items}, key=lambda x: (x is not None, x or ""))
    number = {x: k for k, x in enumerate(names)}
    parts, at, found = [np.zeros(0, np.int64)], 0, {}
    for item, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
        n = min(window, len(ids))
        if n:
            keys = _rolled(_mix(ids), n)
            found.setdefault(n, []).append((keys, np.arange(at, at + len(keys), dtype=np.int32), np.full(len(keys), number[item], np.int32)))
        parts.append(ids)
        at += len(ids)
    all_ids, tables = np.concatenate(parts).astype(np.int32), {}
    for n, some in found.items():
        hashes, place, owner = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((place, owner, hashes))
        hashes, place, owner = hashes[order], place[order], owner[order]
        # A window that an item holds again is kept once.
        new = np.ones(len(hashes), bool)
        pair = np.nonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))[0]
        for cut in range(0, len(pair), 1 << 16):
            p = pair[cut : cut + (1 << 16)]
            step = np.arange(n)
            new[p + 1] = (all_ids[place[p][:, None] + step] != all_ids[place[p + 1][:, None] + step]).any(1)
        tables[n] = (hashes[new], place[new], owner[new])
    return Windows(vocabulary, names, all_ids, tables)


def occurrences(windows: Windows, ids: np.ndarray) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first word, length, items) of every window that occurs in ``ids``; 0 separates documents."""
    clear = np.concatenate([[0], np.cumsum(ids == 0)])
    for n, (hashes, place, owner) in windows.tables.items():
        if len(ids) < n:
            continue
        at = np.nonzero(clear[n:] == clear[:-n])[0]
        if not len(at):
            continue
        keys = _rolled(_mix(ids), n)[at]
        first = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        some = hashes[first] == keys
        last = np.searchsorted(hashes, keys[some], side="right")
        for i, k, end in zip(at[some].tolist(), first[some].tolist(), last.tolist(), strict=True):
            own = ids[i : i + n]
            met = [windows.names[owner[j]] for j in range(k, end) if np.array_equal(windows.ids[place[j] : place[j] + n], own)]
            if met:
                yield i, n, met


def _scan(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    get = windows.vocabulary.get
    for batch in slices(batches):
        sizes, parts = [], [np.zeros(1, np.int64)]
        for text in byte_texts(batch):
            w = words_of(text)
            sizes.append(len(w))
            parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            parts.append(parts[0])
        starts = np.cumsum([1, *(n + 1 for n in sizes)])
        hit: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for i, n, owners in occurrences(windows, np.concatenate(parts)):
            d = int(np.searchsorted(starts, i, side="right")) - 1
            hit.setdefault(d, []).append((i - int(starts[d]), i - int(starts[d]) + n))
            items.setdefault(d, set()).update(x for x in owners if x is not None)
        ranges = [merged(hit[d]) if d in hit else [] for d in range(len(sizes))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array([[x for r in rs for x in r] for rs in ranges], pa.list_(pa.int64())),
                pa.array([sorted(items.get(d, ())) for d in range(len(sizes))], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "ranges", "items"],
        )


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, of the words inside any of ``ranges``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCANNED = "doc_id long, n_words long, ranges array<long>, items array<string>"


def _groups(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in groups of about ``most`` bytes, brought to the driver one group at a time; one item may be more."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], bytes(r["text"])) for r in own.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_words, ranges, items) of each row: hit words as flat [from, to) pairs, and the items' ids as text.

    Null and empty texts have no words. Items without words are ignored; windows of items with a null id are hit like any
    others, but give ``items`` no id; a repeated id is one item with the windows of all its rows. A benchmark beyond ``most`` bytes is scanned for in
    groups; rows are then merged by a number given to each row. Repeated rows are kept.
    """
    spark = docs.sparkSession
    groups = _groups(benchmark, most)

    def scanned(rows: DataFrame, items: list, schema: str = SCANNED) -> DataFrame:
        shared = spark.sparkContext.broadcast(build(items, window))
        return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scan(it, shared.value), schema)

    first = next(groups)
    rest = next(groups, None)
    if rest is None:
        return scanned(docs, first)
    # Ids may repeat or be null: number the rows once, in a table, and scan that for each group.
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("own_id"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    parts = scanned(rows, first)
    while rest is not None:
        parts = parts.unionByName(scanned(rows, rest))
        rest = next(groups, None)
    joined = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [[x for r in merged(list(zip(f[::2], f[1::2], strict=True))) for x in r] for f in b.column("flat").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("own_id"), b.column("n_words"), pa.array(flat, pa.list_(pa.int64())), b.column("items")], ["doc_id", "n_words", "ranges", "items"])

    return rows.select("doc_id", "own_id").join(joined, "doc_id").mapInArrow(union, SCANNED)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``; see ``hits``."""
    found = hits(docs, benchmark)
    # [from, to) pairs lie flat: the sum of the ends less that of the starts.
    n_hit = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", F.array_sort("items")), "UTF-8"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def without(text: bytes, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of ``ranges`` and what lies between them."""
    marks = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    first, last = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : first[a]])
        at = last[b - 1]
    return b"".join([*out, text[at:]]).decode()


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return merged(list(zip(flat[::2], flat[1::2], strict=True)))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """``docs``, all columns, without contaminated documents and without any benchmark passage.

    Documents with a twentieth of their words hit go; fewer hit words are cut out of the text (and n_chars, if
    there is such a column, is counted again). Other rows, null texts among them, stay as they are. A
    benchmark beyond ``most`` bytes is scanned for group by group; the last scan decides by all hits.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names, mark, before = docs.columns, "__decontamination", F.array().cast("array<bigint>")
    groups = _groups(benchmark, most)
    items, more = next(groups), next(groups, None)
    while True:
        shared = spark.sparkContext.broadcast(build(items, window))

        def found(text, earlier, shared):
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text, pa.string(), from_pandas=True)], ["doc_id", "text"])
            at = 0
            for b in _scan(iter([rows]), shared.value):
                for n, flat in zip(*(b.column(c).to_pylist() for c in ("n_words", "ranges")), strict=True):
                    yield n, _pairs([*(earlier.iloc[at] if earlier.iloc[at] is not None else ()), *flat])
                    at += 1

        if more is None:
            break

        @F.pandas_udf("array<long>")
        def gather(text, earlier, shared=shared, found=found):
            import pandas as pd

            return pd.Series([[x for r in ranges for x in r] for _, ranges in found(text, earlier, shared)])

        before = gather("text", before)
        items, more = more, next(groups, None)

    @F.pandas_udf("struct<cut:boolean,gone:boolean,text:string>")
    def decide(text, earlier):
        import pandas as pd

        rows = []
        for i, (n, ranges) in enumerate(found(text, earlier, shared)):
            gone = bool(ranges) and 20 * sum(y - x for x, y in ranges) >= n
            rows.append((bool(ranges), gone, without(text.iloc[i].encode(), ranges) if ranges and not gone else None))
        release()
        return pd.DataFrame(rows, columns=["cut", "gone", "text"])

    out = docs.withColumn(mark, decide("text", before)).where(f"not {mark}.gone")
    changed = {"text": F.when(F.col(f"{mark}.cut"), F.col(f"{mark}.text")).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col(f"{mark}.cut"), F.length(f"{mark}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*names)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see ``hits`` for null
    texts and ids, repeated rows and empty tables."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE: dict[str, str] = {}
