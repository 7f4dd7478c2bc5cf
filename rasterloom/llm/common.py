"""What the operators of this folder share: reading tables, the shared working folder, bytes of Arrow strings."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that very long texts don't fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. Only where that is unset (tests) a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rasterloom-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd", **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and losing an executor costs nothing before it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, *kept: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with all columns but the kept ones under names that no operator uses, and what gives them back, with further columns after them."""
    names = [c if c in kept else f"column_{k}" for k, c in enumerate(df.columns)]
    was = df.columns
    return df.toDF(*names), lambda out, *more: out.select(*[F.col(n).alias(c) for n, c in zip(names, was)], *more)


def few(ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most `most` rows (8 MB), which is counted; else left as it is, to be shuffled."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes as uint8, offsets as int64 from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows. A worker is used for many tasks; before and after each it gives back what it no longer needs."""
    trim()
    try:
        for b in rows:
            if b.num_rows:
                yield b
    finally:
        trim()


def trim() -> None:
    """Returns free memory of this process, Arrow's and the allocator's, to the system where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished steps; between steps that are staged nothing of them is needed."""
    gc.collect()
    spark._jvm.System.gc()
