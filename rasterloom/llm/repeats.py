"""Removal of repeated byte strings: every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

Anchors (1 in 40 bytes or so) are the positions whose hash of K bytes is least in a window of W = LENGTH - K + 1; any two equal
strings of LENGTH bytes hold an anchor at the same place. So only anchors are shuffled:
1. occurrences with the same anchor and the same surroundings (all strings around the anchor, by a BLAKE2b digest of their bytes): all but the first are covered whole;
2. of anchors with different surroundings, one occurrence of each kind is compared with the others: the surroundings are suffix-sorted
   to the right and to the left of the anchor (suffixes.py); strings that start i bytes before the anchor are equal where both
   sides share enough, and all but the first are covered;
3. an anchor of more than HOT kinds, or of more than LOCAL within one batch, is not gathered: its strings are compared by polynomial hash
   and BLAKE2b digest instead, one row each, with partial minima.
The covered stretches of a document meet its text in one join by doc_id.

Texts are UTF-8 bytes; null is empty; matches never cross documents; strings are judged on the input. doc_id names a document: repeated
rows of one doc_id don't cover each other. Rows without doc_id lose nothing and cover nothing. docs is read three times and has to give the same batches
each time, as files do; what comes out of a shuffle is to be written first.

Polynomial hashes only order and find; what is removed rests on compared bytes (2) or on a cryptographic digest of them (1, 3), so that no text made
to make hashes collide loses a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read, release, small_batches, staged, utf8
from .shingles import mix
from .suffixes import Extensions, PrefixHash, sorted_extensions

LENGTH, K = 100, 20
W = LENGTH - K + 1
HOT, LOCAL = 1 << 16, 256
SALTS = 8
CHUNK = 1 << 20  # bytes hashed at once
MEMBERS = 40_000  # occurrences sorted at once, about


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w neighbours, by doubling."""
    n = 1
    while n < w:
        k = min(n, w - n)
        x = f(x[:-k], x[k:])
        n += k
    return x


def digests(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit BLAKE2b digest of each part data[at : end]."""
    whole = data.tobytes()
    return np.frombuffer(b"".join([hashlib.blake2b(whole[i:j], digest_size=8).digest() for i, j in zip(at.tolist(), end.tolist())]), "<u8").copy()


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in it, hash of the K bytes, hash of the surroundings) of all anchors of texts data[at[k] : at[k + 1]]."""
    out, size, lengths = [], len(data), np.diff(at)
    for low in range(0, size, CHUNK):
        first, end = max(0, low - 2 * LENGTH), min(size, low + CHUNK + 2 * LENGTH)
        own = data[first:end]
        if len(own) < LENGTH:
            continue
        key = PrefixHash(own)
        h = mix((key.sums[K:] - key.sums[:-K]) * key.down[: len(own) - K + 1])
        top = (h >> np.uint64(32)).astype(np.uint32)
        least = _slide(top, W, np.minimum)
        edge = np.zeros(W - 1, np.uint32)
        a = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), W, np.maximum) == top)
        place = a + first
        doc = np.searchsorted(at, place, side="right") - 1
        ok = (place >= low) & (place < low + CHUNK) & (place + K <= at[doc + 1]) & (lengths[doc] >= LENGTH)
        a, place, doc = a[ok], place[ok], doc[ok]
        left, right = np.maximum(place - (W - 1), at[doc]), np.minimum(place + LENGTH, at[doc + 1])
        side = digests(own, left - first, right - first)
        side = mix(side + (place - left).astype(np.uint64) * np.uint64(1_000_003) + (right - left).astype(np.uint64))
        out.append((doc, place - at[doc], h[a], side))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Anchors of a batch in the order (key, side, doc, place), with flags: first of its (key, side); a repeat of it in this batch; of a locally hot key."""
    doc_ids = b.column("doc_id")
    data, at = utf8(b.column("text"))
    doc, place, key, side = anchors(data, at)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)[doc]
    ids = doc_ids.fill_null(0).to_numpy()[doc]
    ids, place, key, side = (x[known] for x in (ids, place, key, side))
    order = np.lexsort((place, ids, side, key))
    ids, place, key, side = (x[order] for x in (ids, place, key, side))
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    new = new_key | np.append(True, side[1:] != side[:-1])[: len(key)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    repeat = (ids != ids[head]) | (place != place[head])
    group = np.cumsum(new_key) - 1
    kinds = np.bincount(group, new)[group] if len(key) else np.zeros(0)
    return ids, place, key, side, new, repeat, kinds > LOCAL, new_key


def _rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        ids, place, key, side, new, _, hot, new_key = _batch(b)
        take = new & (~hot | new_key)  # of a hot key one occurrence, as a mark
        yield pa.record_batch([pa.array(key[take].view(np.int64)), pa.array(side[take].view(np.int64)), pa.array(ids[take]), pa.array(place[take].astype(np.int32)), pa.array(hot[take])], ["key", "side", "doc", "place", "hot"])


def _local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        ids, place, _, _, new, repeat, hot, _ = _batch(b)
        take = repeat | new & hot
        yield pa.record_batch([pa.array(repeat[take]), pa.array(ids[take]), pa.array(place[take].astype(np.int32))], ["repeat", "doc", "place"])


def _surroundings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, doc, place, left (bytes before the anchor), piece for occurrences to be sorted."""
    names = ["key", "doc", "place", "left", "piece"]
    for b in batches(rows):
        data, at = utf8(b.column("text"))
        keys, docs, places, lefts, pieces = [], [], [], [], []
        for i, (doc, wanted) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("wanted").to_pylist())):
            text = data[at[i] : at[i + 1]]
            for w in wanted:
                p = w["place"]
                low = max(0, p - (W - 1))
                if w["hot"] or p + K > len(text):
                    continue
                keys.append(w["key"])
                docs.append(doc)
                places.append(p)
                lefts.append(p - low)
                pieces.append(text[low : p + LENGTH].tobytes())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(lefts, pa.int32()), pa.array(pieces, pa.binary())], names)


def _strings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, doc, start of every string around occurrences of hot anchors."""
    for b in batches(rows):
        data, at = utf8(b.column("text"))
        out = []
        for i, (doc, wanted) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("wanted").to_pylist())):
            text = data[at[i] : at[i + 1]]
            starts = [np.arange(max(0, w["place"] - W + 1), min(w["place"], len(text) - LENGTH) + 1) for w in wanted if w["hot"]]
            if not starts or not len(s := np.unique(np.concatenate(starts))):
                continue
            low, high = int(s[0]), int(s[-1]) + LENGTH
            out.append((mix(PrefixHash(text[low:high])(s - low, np.full(len(s), LENGTH))), digests(text[low:high], s - low, s - low + LENGTH), np.full(len(s), doc), s.astype(np.int32)))
        if out:
            a, c, d, s = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(s)], ["h1", "h2", "doc", "start"])


def covered_in_groups(key: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For occurrences sorted by (key, doc, place): (least, greatest) i such that the string from i bytes before the anchor also starts earlier; least > greatest: none."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    anchor = np.cumsum(size) - size + left
    right = np.minimum(size - left, LENGTH)
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    hashes = PrefixHash(data)
    sides = []
    for most, step in ((right, 1), (left.astype(np.int64), -1)):
        order, shared = sorted_extensions(Extensions(data, hashes, anchor, most, step), group)
        sides.append((order, shared))
    least, greatest = np.full(len(key), LENGTH, np.int64), np.full(len(key), -1, np.int64)

    def classes(side: int, depth: int) -> np.ndarray:
        order, shared = sides[side]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < depth)
        return out

    for i in range(W):
        own = np.flatnonzero((left >= i) & (right >= LENGTH - i))
        if len(own) < 2:
            continue
        both = classes(0, LENGTH - i)[own] * np.int64(len(key) + 1) + classes(1, i)[own]
        _, first = np.unique(both, return_index=True)
        late = np.ones(len(own), bool)
        late[first] = False
        hit = own[late]
        least[hit] = np.minimum(least[hit], i)
        greatest[hit] = np.maximum(greatest[hit], i)
    return least, greatest


def _sorted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, start, end of covered stretches; rows come sorted by (key, doc, place), a key's rows never split over tasks."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, doc, place, left = (t.column(c).to_numpy() for c in ("key", "doc", "place", "left"))
        least, greatest = covered_in_groups(key, doc, place, left, t.column("piece").to_pylist())
        hit = least <= greatest
        return pa.record_batch([pa.array(doc[hit]), pa.array((place[hit] - greatest[hit]).astype(np.int32)), pa.array((place[hit] - least[hit] + LENGTH).astype(np.int32))], ["doc", "start", "end"])

    held: list[pa.RecordBatch] = []
    for b in batches(rows):
        key = b.column("key").to_numpy()
        if held and sum(x.num_rows for x in held) >= MEMBERS:
            before = held[-1].column("key")[-1].as_py()
            cut = int(np.argmax(key != before)) if (key != before).any() else len(key)
            if cut:
                held.append(b.slice(0, cut))
            if cut < len(key):
                yield done(held)
                held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield done(held)


def _finished(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        data, at = utf8(b.column("text"))
        out = []
        for i, parts in enumerate(b.column("parts").to_pylist()):
            text = data[at[i] : at[i + 1]]
            runs = merged(parts or [], len(text))
            kept, p = hashlib.sha256(), 0
            for low, high in runs:
                kept.update(text[p:low])
                p = high
            kept.update(text[p:])
            out.append((len(text), sum(h - l for l, h in runs), len(runs), kept.hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.record_batch([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(parts: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes within size that the stretches cover."""
    out: list[list[int]] = []
    for low, high in sorted((max(0, p["start"]), min(p["end"], size)) for p in parts):
        if low >= high:
            continue
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(l, h) for l, h in out]


def covered(docs: DataFrame) -> DataFrame:
    """doc, parts: array of (start, end) stretches of bytes that also stand earlier, for every document that has some."""
    spark = docs.sparkSession
    small_batches(spark)
    local = staged(docs.mapInArrow(_local, "repeat boolean, doc long, place int"))
    rows = docs.mapInArrow(_rows, "key long, side long, doc long, place int, hot boolean").repartition("key")
    own = Window.partitionBy("key", "side").orderBy("doc", "place")
    rows = rows.withColumn("nth", F.row_number().over(own)).withColumn("doc0", F.first("doc").over(own)).withColumn("place0", F.first("place").over(own))
    whole = Window.partitionBy("key")
    rows = rows.withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(whole)).withColumn("hot", F.max("hot").over(whole) | (F.col("kinds") > HOT))
    first = F.col("nth") == 1
    later = ~first & ((F.col("doc") != F.col("doc0")) | (F.col("place") != F.col("place0")))
    rows = rows.where(later | first & ((F.col("kinds") > 1) | F.col("hot")))
    rows = staged(rows.select(later.alias("repeat"), F.when(~later, F.col("key")).alias("key"), "doc", "place", "hot"))
    release(spark)
    around = [F.greatest(F.col("place") - (W - 1), F.lit(0)).alias("start"), (F.col("place") + LENGTH).alias("end")]
    parts = rows.where("repeat").select("doc", *around).unionByName(local.where("repeat").select("doc", *around))
    wanted = rows.where("not repeat").select("doc", "key", "place", "hot").unionByName(local.where("not repeat").select("doc", F.lit(0).cast("long").alias("key"), "place", F.lit(True).alias("hot")))
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "hot")).alias("wanted"))  # as many as a document's anchors at most
    texts = docs.join(wanted.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "wanted")
    pieces = texts.where(F.exists("wanted", lambda w: ~w["hot"])).mapInArrow(_surroundings, "key long, doc long, place int, left int, piece binary")
    groups = pieces.repartition("key").sortWithinPartitions("key", "doc", "place").mapInArrow(_sorted, "doc long, start int, end int")
    parts = staged(parts.unionByName(groups))
    release(spark)
    if not (rows.where("hot").isEmpty() and local.where("not repeat").isEmpty()):
        strings = staged(texts.where(F.exists("wanted", lambda w: w["hot"])).mapInArrow(_strings, "h1 long, h2 long, doc long, start int"))
        least = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
        # one string may stand at any share of the places, so they meet its first in SALTS parts
        least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = strings.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int"))
        late = salted.join(least, ["h1", "h2", "salt"]).where((F.col("doc") != F.col("least.doc")) | (F.col("start") != F.col("least.start")))
        # starts within LENGTH of each other cover all between them
        runs = late.groupBy("doc", F.floor(F.col("start") / LENGTH).alias("run")).agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end"))
        parts = parts.unionByName(runs.select("doc", "start", "end"))
    return parts.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("parts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = covered(docs).withColumnRenamed("doc", "doc_id")
    rows = docs.join(parts, "doc_id", "left").select("doc_id", "text", "parts")
    return rows.mapInArrow(_finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, h[2 * i + 1 : 2 * i + 200] AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM s),
a AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(CASE WHEN k = 1 THEN h[1 : 2 * lo] ELSE '' END || h[2 * hi + 1 : 2 * coalesce(nxt, len(h) // 2)], '' ORDER BY k) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
