"""What the operators of this subpackage share: table reading, written intermediate tables, fold rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that are handed to a Python worker at once, unless the session says otherwise: texts can be long.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches end by their bytes (Spark's own bound is on rows and far larger in bytes)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that a worker's allocators keep for themselves: workers outlive their task, beside the next one's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's readers touch the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine serves in local mode
    (tests); elsewhere that is an error, since executors wouldn't see one another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "sigloom")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Removes tables that written() has made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets go of shuffle files: Spark deletes them once the driver has collected the plans that made them, which by itself may
    take until long after a job of many steps has filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids fall in the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]
