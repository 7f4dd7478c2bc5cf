"""Token ids in Parquet list columns, in ascending doc_id order, for selective reads.

Texts are dealt to ranges of doc_id, sorted there, encoded and written by Spark's writer: ids dictionary-encoded, doc_id and positions
delta-encoded, row groups and pages of set sizes, page indexes on. One file holds one range; each row knows its place in its range, so
only one number for each file is needed to know its place in the whole. Null texts are empty; rows with one doc_id stay side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, shared_folder, small_batches
from .encoding import encoder, lists

NAME, END = "word_bpe_49k.json", 1
ROW_GROUP, PAGE = 32 << 20, 1 << 16  # bytes
HELD = 1_000_000  # strings whose ids a worker keeps, long ones counted as several
LAYOUT = {
    "compression": "snappy", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#place": "false", "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, name: str = NAME, end: int = END) -> DataFrame:
    """Writes doc_id, part (the file's number), place (ids before it in that file), n_tokens and ids of every row under path; the rows as read back."""
    spark = docs.sparkSession
    small_batches(spark)
    last = np.array([end], "<u4").tobytes()

    def encoded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(name, HELD), TaskContext.get().partitionId(), 0
        for b in batches(rows):
            ids = [x + last for x in enc.column(b.column(1))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            before = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.record_batch([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), lists(ids)], ["doc_id", "part", "place", "n_tokens", "ids"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encoded, SCHEMA).write.options(**LAYOUT).parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files have them. What the driver gathers is one sum for each file."""

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).view("<u4")
            n = np.diff(at)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), b.column("place"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist()
    base = spark.createDataFrame([(p, s) for (p, _), s in zip(sums, starts)], "part int, base long")
    rows = files.mapInArrow(summed, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), shared_folder(spark)))
