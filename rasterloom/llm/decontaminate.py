"""Benchmark decontamination with one Aho-Corasick automaton over normalised test windows.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII bytes; all else separates. A window is SPAN consecutive words of an
item, or the whole item where it has fewer. Texts are normalised to " w1 w2 ... " and scanned once; every byte of the normal
form knows its place in the original, so hits come back as spans of the original's UTF-8 bytes.

The automaton is broadcast, so its items are bounded: more than BLOCK bytes of items are dealt by hash to several automata, which
scan one after another with the hits carried along. Null and empty texts have no words and are never contaminated; items without
words have no window; rows that share an item_id count as one item; a null item_id counts as an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, batches, read, small_batches, utf8

SPAN = 13
SHARE = 20  # contaminated: hits are at least one word in SHARE
BLOCK = 4 << 20  # bytes of items in one automaton; its windows are about SPAN times that

_NORMAL = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _NORMAL[_c] = _c
for _c in range(65, 91):
    _NORMAL[_c] = _c + 32


def normalised(data: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(the normal form, one character for each byte; where each of its bytes stands in data; positions of the space before each word).

    The form is "" without words. The last space has no original: its place is the end of data.
    """
    form = np.empty(len(data) + 2, np.uint8)
    form[0] = form[-1] = 32
    form[1:-1] = _NORMAL[data]
    word = form != 32
    keep = np.flatnonzero(word | np.append(word[1:], False))
    if not len(keep):
        return "", keep, keep
    out = np.append(form[keep], np.uint8(32))
    return out.tobytes().decode("latin-1"), np.append(keep - 1, len(data)), np.flatnonzero(out == 32)[:-1]


def windows(text: str, span: int = SPAN) -> set[str]:
    form, _, _ = normalised(np.frombuffer(text.encode(), np.uint8))
    words = form.split()
    return {" " + " ".join(words[i : i + span]) + " " for i in range(max(1, len(words) - span + 1))} if words else set()


class Scanner:
    """An automaton over the windows of (item, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN):
        import ahocorasick

        own: dict[str, set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows(text or "", span):
                own[w].add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in own.items():
            self.automaton.add_word(w, (w.count(" ") - 1, frozenset(ids)))
        if own:
            self.automaton.make_automaton()
        self.empty = not own

    def scan(self, form: str, spaces: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hits as word ranges (first, end) and the items that they come from."""
        if self.empty or not form:
            return [], set()
        found = list(self.automaton.iter(form))
        if not found:
            return [], set()
        ends = np.searchsorted(spaces, [e for e, _ in found])
        return [(int(j) - n, int(j)) for j, (_, (n, _)) in zip(ends, found)], set().union(*(ids for _, (_, ids) in found))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted(ranges):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


HITS = "struct<n_words: long, ranges: array<struct<first: long, end: long>>, spans: array<struct<start: long, end: long>>, items: array<string>>"


def _pass(docs: DataFrame, items: Broadcast, span: int, carried: bool) -> DataFrame:
    """docs with the struct `__hits` added, or widened where an earlier automaton made it."""
    names = [c for c in docs.columns if c != "__hits"]
    kind = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items.value, span)
        for b in batches(rows):
            data, at = utf8(b.column("text"))
            earlier = b.column("__hits").to_pylist() if carried else [None] * b.num_rows
            out = []
            for i, j, old in zip(at[:-1], at[1:], earlier):
                form, places, spaces = normalised(data[i:j])
                ranges, ids = scanner.scan(form, spaces)
                if old:
                    ranges += [(r["first"], r["end"]) for r in old["ranges"]]
                    ids |= set(old["items"])
                ranges = merged(ranges)
                ends = np.append(spaces[1:], len(form) - 1)
                spans = [(int(places[spaces[f] + 1]), int(places[ends[e - 1] - 1]) + 1) for f, e in ranges]
                out.append({"n_words": len(spaces), "ranges": [{"first": f, "end": e} for f, e in ranges], "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(ids)})
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(out, kind)], [*names, "__hits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "__hits")
    return docs.mapInArrow(scan, f"{fields}, `__hits` {HITS}")


def with_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with `__hits`: n_words, merged word ranges, byte spans in the original text, and the items."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in own.distinct().collect()])  # BLOCK bytes or so
        docs = _pass(docs, shared, span, carried=k > 0)
    return docs


def n_hit() -> F.Column:
    return F.aggregate("__hits.ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])


def is_contaminated(share: int = SHARE) -> F.Column:
    return (n_hit() > 0) & (share * n_hit() >= F.col("__hits.n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that are not contaminated."""
    own, back = apart(docs, "text")
    return back(with_hits(own, benchmark).where(~is_contaminated()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.array_join("__hits.items", ",")
    return with_hits(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", F.col("__hits.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__hits.items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


#: The same rows by words and windows as rows.
SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
