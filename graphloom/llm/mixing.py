"""Mixing sources to target weights by fixed-length blocks.

Each source's words, in a fixed order of its documents, are packed into blocks of BLOCK words. The mix
has a slot for each block it takes. An output shard's slots are dealt to sources by a multinomial draw; a
source's k-th slot over all shards takes the block that a pseudorandom permutation of its indices (a
Feistel network, new for each pass over the source) maps k to. Draws are conditioned on the
slots each source must get in all, so a source's total meets its target, and its last slot is trimmed to the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from graphloom.llm.common import byte_texts, slices, stage, table

BLOCK = 512
#: Slots of an output shard, shards at most, and ranges (a source in a shard) that the driver plans at most: then shards grow.
SHARD, MOST_SHARDS, MOST_RANGES = 1024, 1024, 1 << 18
#: Sources that a mix may have: the driver plans them, and their plan is broadcast.
MOST_SOURCES = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
SEED = 17
#: Documents of a bucket of the running sums, about, and buckets of a larger one.
BUCKET, FAN = 256, 1024
#: Rows alike in every way that are joined to their text in one place.
ALIKE = 1024
#: A row's name (rows that are alike in it are interchangeable), and what rows are put in order by.
KEY, MARK = ["key_high", "key_low"], "mark"


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with KEY, a 128-bit hash of all ``columns``, and MARK, a hash of the first three."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = [F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in columns]
    # A null is skipped by the hash, so what is null is hashed too.
    nulls = [x.isNull() for x in own]
    return docs.withColumns({k: F.xxhash64(F.lit(i), *own, *nulls) for i, k in enumerate(KEY)} | {MARK: F.xxhash64(*own[:3], *nulls[:3])})


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n = [len(x.split()) for x in byte_texts(batch)]
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64())], [*own, "size"])


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words of each source: ``share`` of all by repeating weights, none over ``cap`` times its size.

    What is above a cap is shared again by weight among the rest until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        all_w = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * w[i] / all_w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / all_w
            break
        for i in over:
            out[i] = cap * sizes[i]
            free.discard(i)
        left = max(0.0, share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free))
    return out


def _rounds(sid: int, epoch: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, sid, epoch]).integers(1, 1 << 62, 4, dtype=np.uint64) | np.uint64(1)


def permuted(index: np.ndarray, n: int, sid: int, epoch: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Image of each index under the pseudorandom permutation of range(n): four Feistel rounds, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), _rounds(sid, epoch, seed)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ _scramble(a, k, low), a
            else:
                a, b = b, a ^ _scramble(b, k, low)
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _scramble(x: np.ndarray, key: np.uint64, low: np.uint64) -> np.ndarray:
    h = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * key >> np.uint64(17)) & low


@dataclass
class Source:
    sid: int
    name: str | None
    size: int
    target: float
    blocks: int
    passes: list[tuple[int, int]]  # for each pass: slots, words of the last slot


def plan_source(sid: int, name: str | None, size: int, target: float, block: int = BLOCK, seed: int = SEED) -> Source:
    """Whole passes take every block; the last takes permuted blocks until the target's words are reached."""
    blocks, left, passes = -(-size // block), round(target), []
    while size and left >= size:
        order_last = permuted(np.array([blocks - 1]), blocks, sid, len(passes), seed, inverse=True)[0]
        passes.append((blocks, size - (blocks - 1) * block if order_last == blocks - 1 else block))
        left -= size
    if size and left:
        short = block * blocks - size
        at = int(permuted(np.array([blocks - 1]), blocks, sid, len(passes), seed, inverse=True)[0])
        slots = -(-left // block)
        if at < slots - 1 or (at == slots - 1 and left - (slots - 1) * block > block - short):
            slots = -(-(left + short) // block)
            last = left + short - (slots - 1) * block
        else:
            last = left - (slots - 1) * block
        passes.append((slots, last))
    return Source(sid, name, size, target, blocks, passes)


def deal(sources: list[Source], seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(shard, sid, first slot, slots): for each shard a multinomial draw of its slots over the sources, by what each
    has left; the last shard gets the rest."""
    left = np.array([sum(n for n, _ in s.passes) for s in sources], np.int64)
    used = np.zeros(len(sources), np.int64)
    size = max(SHARD, -(-int(left.sum()) // max(1, min(MOST_SHARDS, MOST_RANGES // max(1, len(sources))))))
    shard = 0
    while total := int(left.sum()):
        want = min(size, total)
        got = np.minimum(np.random.default_rng([seed, shard]).multinomial(want, left / total), left)
        for i in np.argsort(got - left, kind="stable"):  # what a source no longer has goes to those with most left
            got[i] += (more := min(int(left[i] - got[i]), want - int(got.sum())))
            if not more:
                break
        for i in np.nonzero(got)[0]:
            yield shard, sources[i].sid, int(used[i]), int(got[i])
        used += got
        left -= got
        shard += 1


def _slots(batches: Iterator[pa.RecordBatch], plans: dict[int, Source], block: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(sid, block, shard, words) of each slot of dealt ranges."""
    for batch in batches:
        for shard, sid, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "sid", "first", "n")), strict=True):
            s, k0 = plans[sid], 0
            for epoch, (slots, last) in enumerate(s.passes):
                k = np.arange(max(first, k0), min(first + n, k0 + slots)) - k0
                if len(k):
                    at = permuted(k, s.blocks, sid, epoch, seed)
                    words = np.where(at == s.blocks - 1, s.size - (s.blocks - 1) * block, block)
                    words[k == slots - 1] = last
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), sid)), pa.array(at), pa.array(np.full(len(k), shard)), pa.array(words)], ["sid", "block", "shard", "words"])
                k0 += slots


def _running(df: DataFrame, size: str, order: list[str], out: str) -> DataFrame:
    """Sum of ``size`` over the rows of the same ``sid`` before each row, in three levels of bounded groups."""
    cells = stage(df.groupBy("sid", "bucket").agg(F.sum(size).alias("s")).withColumn("upper", F.floor(F.col("bucket") / FAN)), "cells")
    before = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uppers = cells.groupBy("sid", "upper").agg(F.sum("s").alias("s")).withColumn("up", before(Window.partitionBy("sid").orderBy("upper"))).select("sid", "upper", "up")
    at = cells.withColumn("own", before(Window.partitionBy("sid", "upper").orderBy("bucket"))).join(uppers, ["sid", "upper"]).select("sid", "bucket", (F.col("up") + F.col("own")).alias("base"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("inside", inside).join(at, ["sid", "bucket"]).withColumn(out, F.col("base") + F.col("inside")).drop("inside", "base")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, ranges, row.

    ``ranges`` are the words taken as structs (first, words, times) of the document's words. Sources are ordered by
    code point, null last (its own source). Null and empty texts have size 0 and are not taken. Repeated
    rows and null ids are rows like others. All sizes 0 give targets 0. Reruns agree: every draw depends on the seed
    and on the rows alone. More than MOST_SOURCES sources are an error. Only (id, source, size, key) rows are
    shuffled, no text; one source, one id or copies of one row may be any share of all rows, as running sums and joins go
    by buckets and blocks, and copies of a row are numbered and dealt to buckets by that number.
    """
    return _mixed_rows(keyed(docs, ["doc_id", "source", "text"]), weights, share, cap, block, seed).drop("row", *KEY)


def _mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``mix`` of rows that have a KEY and a MARK, with the row's number and its KEY."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long"), "source", *KEY, MARK, "text").mapInArrow(_sizes, "doc_id long, source string, key_high long, key_low long, mark long, size long")
    sized = stage(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    out = "doc_id long, size long, source_size long, target double, taken long, ranges array<struct<first:long,words:long,times:long>>, row long, key_high long, key_low long"
    if not sums:
        return spark.createDataFrame([], out)
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["s"] for r in sums], weights, share, cap)
    sources = [plan_source(i, r["source"], r["s"], t, block, seed) for i, (r, t) in enumerate(zip(sums, wanted, strict=True))]
    listed = F.broadcast(spark.createDataFrame([(s.sid, s.name, s.size, float(s.target)) for s in sources], "sid long, name string, source_size long, target double"))
    buckets = max(1, -(-sum(r["n"] for r in sums) // BUCKET))
    # Rows that are alike in every way are interchangeable: they are counted, then numbered.
    rows = sized.groupBy("doc_id", "source", "size", MARK, *KEY).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = rows.join(listed, rows["source"].eqNullSafe(listed["name"])).withColumn("bucket", F.pmod(F.xxhash64(MARK, "copy", F.lit(seed)), F.lit(buckets)))
    placed = _running(rows.select("doc_id", "size", "source_size", "target", "sid", "bucket", "copy", MARK, *KEY), "size", ["doc_id", MARK, *KEY, "copy"], "start")
    rows = stage(placed.drop("copy", MARK).withColumn("row", F.monotonically_increasing_id()), "placed")

    plans = spark.sparkContext.broadcast({s.sid: s for s in sources})
    dealt = spark.createDataFrame(list(deal(sources, seed)), "shard long, sid long, first long, n long").repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 64)))
    slots = dealt.mapInArrow(lambda it: _slots(it, plans.value, block, seed), "sid long, block long, shard long, words long")
    # A block's slots take a prefix of it: all but one of them all of it.
    taken = slots.groupBy("sid", "block").agg(F.sort_array(F.collect_list("words")).alias("slots"))

    end = F.col("start") + F.col("size")
    spread = rows.where("size > 0").select("row", "sid", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    met = spread.join(taken, ["sid", "block"]).withColumn("upto", F.explode("slots"))
    base = F.col("block") * block
    first, last = F.greatest("start", base), F.least("end", base + F.col("upto"))
    met = met.select("row", (first - F.col("start")).alias("first"), (last - first).alias("words")).where("words > 0")
    met = met.groupBy("row", "first", "words").agg(F.count("*").alias("times"))
    got = met.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("ranges"))
    none = F.array().cast("array<struct<first:bigint,words:bigint,times:bigint>>")
    return rows.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("ranges", none).alias("ranges"), "row", *KEY)


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def text_of(text: str | None, ranges) -> str | None:
    """The words that the mix takes of a text: runs joined, in order, as often as they are taken."""
    data = (text or "").encode("utf-8", "surrogatepass")
    word = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]])
    # A word begins where a blank is left and ends where one is met.
    first, last = np.nonzero(word[:-1] & ~word[1:])[0], np.nonzero(~word[:-1] & word[1:])[0]
    passes = max((r["times"] for r in ranges), default=0)
    pieces = []
    for k in range(passes):
        run: list[list[int]] = []
        for r in sorted((r for r in ranges if r["times"] > k), key=lambda r: r["first"]):
            if run and run[-1][1] == r["first"]:
                run[-1][1] += r["words"]
            else:
                run.append([r["first"], r["first"] + r["words"]])
        pieces += [data[first[a] : last[b - 1]] for a, b in run]
    return b"\n".join(pieces).decode("utf-8", "surrogatepass")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: all columns, a row for each document of which the mix takes words, with those words as its text.

    Words taken twice are in the text twice; a document that is not taken has no row. n_chars, if there is such a column, is
    counted again. A row is named by a hash of all its columns, so rows of one id, of any sources and texts, are told
    apart. Rows alike in all columns are interchangeable: as many of them are kept as are taken, each with its own words. Texts
    move once, to be joined; of rows that repeat one text for each ALIKE copies.
    """
    # Columns go by their place on the way, so that none can clash with another.
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = {n: own[names.index(n)] for n in ("doc_id", "source", "text")}
    whole = keyed(docs.toDF(*own), [*at.values(), *(c for c in own if c not in at.values())])
    rows = stage(_mixed_rows(whole.select(*KEY, MARK, *(F.col(c).alias(n) for n, c in at.items())), **options).select("row", "taken", "ranges", *KEY), "mixed")
    taken = rows.where("taken > 0").drop("taken")
    again = stage(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"), "again")
    joined = whole.join(taken.drop("row"), KEY)
    if not again.isEmpty():
        parts = F.floor(F.col("n") / ALIKE) + 1
        once = whole.join(again, KEY, "left_anti").join(taken.drop("row"), KEY)
        texts = whole.join(again, KEY, "left_semi").dropDuplicates(KEY).join(again, KEY).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
        copies = taken.join(again, KEY).select(*KEY, "ranges", F.pmod("row", parts).alias("part"))
        joined = once.unionByName(texts.join(copies, [*KEY, "part"]).drop("part"))
    text, rest = at["text"], [StructField(c, f.dataType) for c, f in zip(own, docs.schema.fields, strict=True) if c != at["text"]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = [text_of(t, r) for t, r in zip(batch.column(text).to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(out, pa.string())], [*(f.name for f in rest), text])

    out = joined.select(*own, "ranges").mapInArrow(cut, StructType([*rest, StructField(text, StringType())]))
    if "n_chars" in names:
        k = names.index("n_chars")
        out = out.withColumn(own[k], F.length(text).cast(docs.schema.fields[k].dataType))
    return out.select(*own).toDF(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken; see ``mix`` for null sources, texts and ids,
    repeated rows and empty tables."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE: dict[str, str] = {}
