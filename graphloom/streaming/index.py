"""Incremental indexing under Structured Streaming: file events become micro-batches, each of which refreshes the snapshot.

Batches never overlap, and events that arrive during one are in the next, so none is lost. A batch is idempotent: it
compares the files as they are with the last snapshot, so one that runs again publishes nothing new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.index import Run, index
from graphloom.plans.registry import Registry
from graphloom.sources.files import ignored, language_hint, relative, scan

DEBOUNCE_MS = (100, 60_000)


def file_events(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, language_hint, changed) of files that appear or are written again below a folder."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    path = relative(F.col("path"), root)
    return stream.where(~ignored(path)).select(path.alias("path"), language_hint(path).alias("language_hint"), F.col("modificationTime").alias("changed"))


def distinct_paths(batch: DataFrame) -> DataFrame:
    return batch.select("path").distinct().orderBy("path")


def watch(spark: SparkSession, root: str, store, checkpoint: str, registry: Registry | None = None, debounce_ms: int = 1000, done: Callable[[int, Run], None] | None = None, once: bool = False) -> StreamingQuery:
    """Index a folder whenever files appear in it. ``once`` handles what is there and ends."""
    if not DEBOUNCE_MS[0] <= debounce_ms <= DEBOUNCE_MS[1]:
        raise ValueError(f"debounce of {DEBOUNCE_MS[0]} to {DEBOUNCE_MS[1]} ms")

    def refresh(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            run = index(store, scan(batch.sparkSession, root), registry)
            if done:
                done(epoch, run)

    writer = file_events(spark, root).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def watch_tables(spark: SparkSession, events: DataFrame, state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the last (path, content_hash, language_hint) of a stream of events (path, content_hash, language_hint, changed) as a table.

    A batch reads the newest version of the state and writes the next, named by its epoch: a batch that runs again
    writes the same version again.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        last = F.max_by(F.struct("content_hash", "language_hint", "changed"), F.struct("changed", "content_hash")).alias("v")
        rows = batch.select("path", "content_hash", "language_hint", "changed")
        if epoch:
            rows = rows.unionByName(s.read.parquet(f"{state}/v={epoch - 1}"))
        rows.groupBy("path").agg(last).select("path", "v.*").write.mode("overwrite").parquet(f"{state}/v={epoch}")

    writer = events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and event-time window, with a watermark. An extension: not among the operators that the engine must have."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
