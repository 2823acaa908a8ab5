"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


#: Rows and bytes of an Arrow batch of texts (one row may be more), unless the session sets its own number.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches as BATCH says: a batch of whole texts is held several times over on its way
    through a Python worker. Another number than Spark's default stays."""
    for name, (default, own) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master, where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    bound_batches(df.sparkSession)
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    delete(df.sparkSession, df._staged_path)  # type: ignore[attr-defined]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(file system, path) for a shared folder's address, from a worker or the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as empty text (0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0).cast("bigint"))


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        at, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)
    release()


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on, beside others and the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
