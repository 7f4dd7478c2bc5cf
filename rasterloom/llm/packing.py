"""Best-fit packing planned over a histogram of lengths.

1. Every text becomes pieces of at most `width` tokens (only longer texts are cut); the pieces are written once.
2. A histogram of lengths (at most `width` rows) goes to the driver, which runs best-fit decreasing over counts: bins of equal free
   space are one entry with a count, so the work and the plan grow with the number of lengths, not of texts.
3. Each piece gets its rank among the pieces of its length and takes the planned slot of that (length, rank).

Ranks are made in two steps, counts for each (length, salt) and a row number inside, so a length that a third of all texts
share is spread over many tasks. Null texts are empty (one token, the end). Repeated rows are packed each for itself.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read, small_batches, staged
from .encoding import encoder

NAME, END, WIDTH = "word_bpe_49k.json", 1, 4096
PLAN_BYTES = 64 << 20  # above this a plan is not broadcast but joined


def pieces(docs: DataFrame, name: str = NAME, end: int = END, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    small_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in batches(rows):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.column(b.column(1))):
                ids += last
                out += [(doc, k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), 4 * width)) for part in (ids[at : at + 4 * width],)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset): ranks from 0 within the length, each to a sequence of its own.

    Best-fit decreasing: a piece goes to the fullest sequence that still holds it, else to a new one. Sequences with the same free
    space are taken a run at a time, each filled before the next, so each step handles as many pieces as the run holds.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs (first sequence, count)
    spaces: list[int] = []  # sorted keys of free
    plan, opened = [], 0

    def put(space: int, first: int, count: int) -> None:
        if space:
            if not free[space]:
                bisect.insort(spaces, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= width:
            raise ValueError(f"length {length} is not within 1 to {width}")
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                # As best fit would, a new sequence is filled before the next is opened: `full` of them, then one with the rest.
                each = width // length
                full, rest = divmod(left, each)
                for i in range(each):
                    n = full + (i < rest)
                    if n:
                        plan.append((length, rank, n, opened, i * length))
                        rank += n
                if full:
                    put(width - each * length, opened, full)
                if rest:
                    put(width - rest * length, opened + full, 1)
                opened += full + (rest > 0)
                left = 0
                continue
            space = spaces[k]
            first, count = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(k)
            # As best fit would, a sequence just taken is the fullest that fits until it is filled: `full` of them, then one with the rest.
            each = space // length
            full = min(count, left // each)
            rest = left % each if full < count else 0
            for i in range(each):
                n = full + (i < rest)
                if n:
                    plan.append((length, rank, n, first, width - space + i * length))
                    rank += n
            used = full + (rest > 0)
            if used < count:
                put(space, first + used, count - used)
            if full:
                put(space - each * length, first, full)
            if rest:
                put(space - rest * length, first + full, 1)
            left -= full * each + rest
    return plan


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """rows with rank: 0, 1, ... among rows of one length. No task holds all rows of a length."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    inside = salted.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    return inside.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("salt", "base", "inside")


def pack(parts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which must be a written table."""
    spark = parts.sparkSession
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    plan = best_fit(histogram, width)
    rows = ranked(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if 40 * len(plan) > PLAN_BYTES:
        slots = spark.createDataFrame(plan, "length long, first long, n long, sequence long, offset long").withColumn("rank", F.explode(F.expr("sequence(first, first + n - 1)"))).select("length", "rank", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
        return rows.join(slots, ["length", "rank"]).select(*columns)
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def placed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = shared.value
        top = np.int64(max(histogram.values(), default=0) + 1)
        keys = plan_[:, 0] * top + plan_[:, 1]
        for b in batches(batches_):
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            row = plan_[np.searchsorted(keys, length * top + rank, side="right") - 1]
            yield pa.record_batch([*(b.column(c) for c in columns[:5]), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], columns)

    return rows.select(*columns[:5], "rank").mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(staged(pieces(read(spark, sf_dir, "documents"))))
