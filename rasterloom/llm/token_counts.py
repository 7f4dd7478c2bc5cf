"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table (one blob of pre-tokens, one byte for each length) of the pre-tokens that are most frequent in all texts, broadcast;
tier two is each worker's cache, filled by the tokenizers library on a miss. What is shuffled are counts of pre-tokens, for the table; no text is.
The table decides only how often a worker has to encode, never a count. Null counts as empty: 0 bytes, 0 tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, small_batches, staged, texts
from .encoding import Encoder, pieces_of, tokenizer_path

HELD = 1 << 17  # pre-tokens that a task counts before it hands on what it has; they are added up after
TABLE = 1 << 15  # pre-tokens in tier one; a few hundred KB
LONGEST = 64  # characters of a pre-token in tier one
LIMIT = 1024


def word_counts(docs: DataFrame, name: str) -> DataFrame:
    """word, n of all pre-tokens of all texts that the cut is certain for (the others are never looked up), but for those longer than LONGEST and those that occur once."""

    def rows(seen: Counter) -> pa.RecordBatch:
        some = [(w, n) for w, n in seen.items() if len(w) <= LONGEST and "\0" not in w]
        return pa.record_batch([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    def counted(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pieces_of(name), Counter()
        for b in batches(batches_):
            for text in texts(b.column(0)):
                seen.update(cut(text) or [])
                if len(seen) > HELD:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def frequent(docs: DataFrame, name: str) -> tuple[bytes, bytes]:
    """Tier one: (the pre-tokens joined by NUL, their lengths in tokens as bytes), most frequent first. It has all that occur at least so often, for
    the lowest such bound that leaves TABLE at most; the bounds tried are 64 to each doubling, so the driver gathers their sizes and then TABLE rows at most."""
    counts = staged(word_counts(docs, name))
    least, size = None, 0
    for step in sorted(counts.groupBy(F.floor(F.log2("n") * 64)).agg(F.min("n").alias("least"), F.count("*").alias("size")).collect(), key=lambda r: -r.least):
        size += step["size"]
        if size > TABLE:
            break
        least = step["least"]
    if least is None:
        return b"", b""
    found = counts.where(F.col("n") >= least).toArrow()
    total = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))
    enc = Encoder(name)
    known = [(w, n) for w in sorted(total, key=lambda w: (-total[w], w)) if (n := enc.count(w)) < 256]
    return "\0".join(w for w, _ in known).encode(), bytes(n for _, n in known)


def token_counts(docs: DataFrame, name: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, in one pass after that for the table; no text is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path(name)
    table = spark.sparkContext.broadcast(frequent(docs, name))

    def counted(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = table.value
        enc = Encoder(name, dict(zip(words.decode().split("\0"), lengths)) if lengths else {}, path)
        for b in batches(batches_):
            n = [enc.count(t) for t in texts(b.column(1))]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), "byte_bpe_50k.json")
