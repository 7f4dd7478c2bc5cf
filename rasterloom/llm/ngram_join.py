"""N-gram Jaccard join by token-combination prefixes.

Tokens are a document's distinct shingles. Two documents x, y link when |x & y| / |x | y| >= t; then they have a = t (|x| + |y|) / (1 + t)
tokens in common at least. In a global order of tokens, the first |x| - a + k tokens of x and the first |y| - a + k of y share at least k,
the first k that x and y have in common. The order goes by frequency class, rare tokens first. A document is indexed by what may be
its first common tokens with another one:
  - a rare token alone (k = 1), and for frequent tokens, which only documents made mostly of shared text have in their prefix,
  - a frequent token with another one after it (k = 2), and one of class HIGH or more with two after it (k = 3).
The prefix is extended by one token for each further token of a combination. As combinations grow with the k-th power of a document's
length, k is at most 3 up to SIZES[3] tokens, 2 up to SIZES[2] and 1 beyond; a pair goes by its larger document, so one near such a
border is indexed both ways. Classes come from counters over all documents (WIDTH of them, summed in slices; half a byte each is broadcast).
Counters only decide how tokens are indexed, never what links.

Each entry carries the most tokens that its document can share with another for which this is the first thing in common (what comes after it in the
order). Buckets are not expanded to pairs. First each bucket compares all members with one pivot, the member with the fewest tokens of its own; links found
contract into components, and buckets within one component are done. The others go on, those with one pivot together: small ones
compare members of different components, large ones take further pivots in rounds that multiply their number until all such pairs are
tested or the components have met. Before a pair is compared at all, its sizes, what its entries leave to be shared, what its prefixes can't
have in common, and parities of the sets have to allow a link. So components are exact, while a group of copies of any size costs about one comparison
for each member. Candidates are verified exactly on the whole sets. Documents with equal sets are one class and joined by their digest.

Null and empty texts have no tokens, link with nothing and are their own component. A row without doc_id belongs to the component of its text's copies.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, few, read, release, small_batches, staged, utf8
from .components import components
from .shingles import mix, shingle_sets

SPAN, NUMERATOR, DENOMINATOR = 4, 85, 100
WIDTH, SLICES = 1 << 23, 16  # counters; parts in which they are summed
SIZES = {3: 64, 2: 384}  # most tokens of a document for which combinations of so many are made
HIGH = 4  # class from which combinations of three are made: 8 times as frequent as the bound of rare tokens
SMALL_BUCKET, LEVELS = 512, 4
SALTS = 16  # parts that the copies of one text are dealt to
LAST = (1 << 63) - 1
SEEN = 200_000  # digests that a task remembers, so that copies within it are indexed once

_FACTOR = {2: np.uint64(0xD6E8FEB86659FD93), 3: np.uint64(0xA3B195354A39B70D)}


class _First:
    """Whether a set's digest is new to this task (as far as it remembers)."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def __call__(self, digest: bytes) -> bool:
        if digest in self.seen:
            return False
        if len(self.seen) < SEEN:
            self.seen.add(digest)
        return True


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def parity_of(tokens: np.ndarray) -> bytes:
    """One bit for about every two tokens: the parity of how many fall on it. Each token that only one of two sets has turns one bit,
    so two parities differ in at most as many bits as the sets in tokens."""
    bits = 64
    while 2 * bits < len(tokens):
        bits *= 2
    return np.packbits(np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def may_link(x: bytes, y: bytes, tokens: int, numerator: int, denominator: int) -> bool:
    """False only for sets (of `tokens` in all) that differ in too many tokens to link, by their parities."""
    while len(x) != len(y):
        x, y = sorted((x, y), key=len)
        half = len(y) // 2
        y = (int.from_bytes(y[:half], "big") ^ int.from_bytes(y[half:], "big")).to_bytes(half, "big")
    differ = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()
    return differ * (denominator + numerator) <= tokens * (denominator - numerator)


def _sets(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest, parity of every row; slices of the counters of each task: slice, counts)."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "blob", "parity"]
        total, first = np.zeros(WIDTH, np.uint32), _First()
        for b in batches(rows):
            sets = shingle_sets(*utf8(b.column("text")), span)
            digests = [digest_of(s) for s in sets]
            if new := [s for s, d in zip(sets, digests) if len(s) and first(d)]:
                np.add.at(total, (np.concatenate(new) & np.uint64(WIDTH - 1)).astype(np.uint32), np.uint32(1))
            yield pa.record_batch([pa.array(np.zeros(b.num_rows, np.int32)), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(map(parity_of, sets), pa.binary())], names)
        if total.any():
            blobs = [zlib.compress(np.minimum(x, 65535).astype("<u2").tobytes(), 1) for x in np.split(total, SLICES)]
            yield pa.record_batch([pa.array(np.ones(SLICES, np.int32)), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(SLICES, pa.binary())], names)

    out = staged(docs.mapInArrow(made, "kind int, doc_id long, n long, blob binary, parity binary"), codec="uncompressed")
    return out.where("kind = 0").select("doc_id", "n", F.col("blob").alias("digest"), "parity"), out.where("kind = 1").select(F.col("n").alias("slice"), "blob")


def _classes(slices: DataFrame, tokens: int) -> bytes:
    """Half a byte for each counter: the class of its tokens. 0: rare, not clearly above the mean load of `tokens` in all; c: 2**(c - 1) times that bound or more."""
    mean = tokens / WIDTH
    bound = mean + 4 * mean**0.5 + 3

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches(rows):
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(blob), "<u2").astype(np.uint32)
        packed = []
        for x in total.values():
            c = np.zeros(len(x), np.uint8)
            often = np.flatnonzero(x > bound)
            c[often] = np.minimum(np.log2(x[often] / bound).astype(np.uint8) + 1, 15)
            packed.append((c[::2] | c[1::2] << 4).tobytes())
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(packed, pa.binary())], ["slice", "half_bytes"])

    found = np.zeros((SLICES, WIDTH // SLICES // 2), np.uint8)
    for r in slices.repartition(SLICES, "slice").mapInArrow(summed, "slice long, half_bytes binary").toLocalIterator():  # WIDTH / 2 bytes in all
        found[r.slice] = np.frombuffer(bytes(r.half_bytes), np.uint8)
    return found.tobytes()


def classes_of(tokens: np.ndarray, half_bytes: np.ndarray) -> np.ndarray:
    at = (tokens & np.uint64(WIDTH - 1)).astype(np.int64)
    return half_bytes[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def most_combined(n: int) -> int:
    """How many tokens a combination of a document of n tokens has at most."""
    return next((k for k in (3, 2) if n <= SIZES[k]), 1)


def index_entries(tokens: np.ndarray, classes: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a set is indexed by: (rare tokens, most that it can share with another set from each on, keys of frequent ones, the same for them)."""
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n * (denominator - numerator) < numerator:  # too small to link with any other set
        return tokens[:0], none, tokens[:0], none
    spare = n - -(-numerator * n // denominator)
    rare = tokens[classes == 0][: spare + 1]
    reach = n - np.arange(len(rare))
    if len(rare) > spare:
        return rare, reach, tokens[:0], none
    often = classes > 0
    own, kind = tokens[often], classes[often]
    order = np.argsort(kind, kind="stable")[: spare + 3 - len(rare)]
    own, kind = own[order], kind[order]
    keys, reaches, before = [], [], np.zeros(len(kind), np.int64)
    for most in sorted({most_combined(n), most_combined(n * denominator // numerator)}):
        size = np.minimum(np.where(kind >= HIGH, 3, 2), most)  # the first token's class and the length decide of how many a combination is
        for k in (1, 2, 3):
            first = np.flatnonzero((size == k) & (before != k))
            first = first[first + len(rare) <= spare]
            key, last = own[first], first
            for j in range(2, k + 1):  # one more token after the last, within the prefix extended by one
                room = np.maximum(min(len(own), spare + j - len(rare)) - 1 - last, 0)
                into = np.repeat(np.arange(len(last)), room)
                last = last[into] + 1 + np.arange(len(into)) - np.repeat(np.cumsum(room) - room, room)
                key = mix(key[into] * _FACTOR[j] + own[last])
            keys.append(key)
            reaches.append(n - (last + len(rare)) + k - 1)
        before = size
    return rare, reach, np.concatenate([tokens[:0], *keys]), np.concatenate([none, *reaches])


def prefix_end(tokens: np.ndarray, classes: np.ndarray, numerator: int, denominator: int) -> int:
    """Where the prefix of single tokens ends in the order of tokens, as a signed number; LAST if among frequent ones."""
    rare, spare = tokens[classes == 0], len(tokens) - -(-numerator * len(tokens) // denominator)
    return int((rare[spare : spare + 1] ^ np.uint64(1 << 63)).view(np.int64)[0]) if len(rare) > spare else LAST


def _entries(docs: DataFrame, span: int, half_bytes: bytes, numerator: int, denominator: int) -> DataFrame:
    """key, id, n, kind, reach: index entries of rare tokens (kind 0) and of frequent ones (1); and for each document a mark (2) with
    the end of its prefix as key and how many rare entries it has as reach. Copies within a task give entries once."""
    shared = docs.sparkSession.sparkContext.broadcast(half_bytes)

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = np.frombuffer(shared.value, np.uint8), _First()
        for b in batches(rows):
            keys, ids, sizes, kinds, reaches = [], [], [], [], []
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(*utf8(b.column("text")), span)):
                if doc is None or not len(s) or not first(digest_of(s)):
                    continue
                classes = classes_of(s, table)
                a, a_reach, c, c_reach = index_entries(s, classes, numerator, denominator)
                if not len(a) + len(c):
                    continue
                mark = np.array([prefix_end(s, classes, numerator, denominator)])
                keys += [a.view(np.int64), c.view(np.int64), mark]
                n = len(a) + len(c) + 1
                ids.append(np.full(n, doc))
                sizes.append(np.full(n, len(s), np.int32))
                kinds.append(np.repeat(np.array([0, 1, 2], np.int32), (len(a), len(c), 1)))
                reaches.append(np.concatenate([a_reach, c_reach, [len(a)]]).astype(np.int32))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, ids, sizes, kinds, reaches)], ["key", "id", "n", "kind", "reach"])

    return docs.mapInArrow(made, "key long, id long, n int, kind int, reach int")


def _fits(m: F.Column, n: F.Column, numerator: int, denominator: int) -> F.Column:
    """Whether sets of such sizes can link at all."""
    return denominator * F.least(m, n) >= numerator * F.greatest(m, n)


def _buckets(entries: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, reach: groups of documents, those of all buckets with one pivot; id, n, shared, end, degree of the documents), both written.

    Of two documents that link, the smaller one's reach at their first common entry suffices for one of its own size (it is `early` there). So a bucket
    needs an early member, and any other member an early one that is not larger and fits by size.
    A bucket's pivot is the member with the fewest tokens that no other has (of those the one in most buckets); as one group, two documents meet once and not for each key that they share. `shared` is a document's size less the rare tokens of its
    prefix that no fitting document has in its own: with a partner whose prefix does not end earlier it has no more than that in common.
    """
    early = F.col("reach") * (numerator + denominator) >= 2 * numerator * F.col("n")
    entries = entries.withColumn("early", early)
    own = Window.partitionBy("key").orderBy("n", F.desc("early"), "id")
    fits = lambda m: m.isNotNull() & _fits(m, F.col("n"), numerator, denominator)
    below, above = F.lag("n").over(own), F.lead("n").over(own)
    before = F.last(F.when(F.col("early"), F.col("n")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rare = entries.where("kind = 0").select("key", "id", "n", "reach", "early", (fits(below) | fits(above)).alias("near"), fits(before).alias("after"), fits(above).alias("under"))
    rare = rare.where("near").select("key", "id", "reach", F.lit(1).alias("one"), (F.col("after") | F.col("early") & F.col("under")).alias("live"))
    often = entries.where("kind = 1")
    several = often.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.when(F.col("early"), F.col("n"))).alias("least")).where("lo < hi and least is not null").select("key", "least")
    often = often.join(several, "key").where("n >= least").select("key", "id", "reach", F.lit(0).alias("one"), F.lit(True).alias("live"))
    rows = staged(rare.unionByName(often))
    kept = rows.groupBy("id").agg(F.sum("one").alias("kept"), F.sum(F.col("live").cast("long")).alias("degree"))
    marks = entries.where("kind = 2").groupBy("id").agg(F.max("n").alias("n"), F.min("reach").alias("rare"), F.max("key").alias("end"))
    nodes = kept.where("degree > 0").join(marks, "id").select("id", "n", (F.col("n") - F.col("rare") + F.col("kept")).alias("shared"), "end", "degree")
    # Of two documents that link, the one whose prefix ends first has at least its share in common. So a bucket needs one that can,
    # and others in it have to end after the first such one.
    nodes = staged(nodes.withColumn("can", denominator * F.col("shared") >= numerator * F.col("n")))
    thin = staged(rows.where("live").join(nodes.select("id", "can", "end", (F.col("shared") - F.col("n")).alias("central"), "degree"), "id").select("key", "id", "reach", "can", "end", "central", "degree"))
    first = F.min(F.when(F.col("can"), F.col("end"))).alias("first")
    best = thin.groupBy("key").agg(first, F.max(F.struct("central", "degree", "id")).getField("id").alias("pivot"), F.count("*").alias("size")).where("first is not null and size > 1")
    groups = thin.join(best, "key").where(F.col("can") | (F.col("end") >= F.col("first"))).groupBy(F.col("pivot").alias("key"), "id").agg(F.max("reach").alias("reach"))
    return staged(groups), nodes


def _linked(pairs: DataFrame, docs: DataFrame, marks: DataFrame, span: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; written. Parities (marks) first rule out most that don't; for the others
    texts are fetched and travel compressed, as that is a third of their sets' size."""

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            data, at = utf8(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array([zlib.compress(data[i:j].tobytes(), 1) for i, j in zip(at[:-1], at[1:])], pa.binary())], ["id", "blob"])

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            x, y, m, n = (b.column(c).to_pylist() for c in ("x", "y", "m", "n"))
            yield b.select(["a", "b"]).filter(pa.array([may_link(p, q, i + j, numerator, denominator) for p, q, i, j in zip(x, y, m, n)], pa.bool_()))

    def compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for rows_ in batches(rows):
            keep = []
            for a, p, q in zip(rows_.column("a").to_pylist(), rows_.column("x").to_pylist(), rows_.column("y").to_pylist()):
                if a != last:
                    last, x = a, _set_of(p, span)
                y = _set_of(q, span)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(x) + len(y) - both))
            yield rows_.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = marks.select(F.col("id").alias("a"), F.col("parity").alias("x"), F.col("n").alias("m")), marks.select(F.col("id").alias("b"), F.col("parity").alias("y"), "n")
    pairs = staged(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", "m", "n").mapInArrow(near, "a long, b long"))
    if pairs.isEmpty():
        return pairs
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.join(few(ids), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])
    held = staged(texts.mapInArrow(packed, "id long, blob binary"), codec="uncompressed")
    release(docs.sparkSession)
    x, y = held.select(F.col("id").alias("a"), F.col("blob").alias("x")), held.select(F.col("id").alias("b"), F.col("blob").alias("y"))
    return staged(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"))


def _set_of(blob: bytes, span: int) -> np.ndarray:
    text = np.frombuffer(zlib.decompress(blob), np.uint8)
    return shingle_sets(text, np.array([0, len(text)]), span)[0]


def _links(docs: DataFrame, rows: DataFrame, buckets: DataFrame, nodes: DataFrame, span: int, numerator: int, denominator: int) -> DataFrame:
    """id, component: the components that all links make, for every document that has one."""

    def pairs(own: DataFrame, pivots: DataFrame, among: F.Column) -> DataFrame:
        """Distinct pairs of a pivot and a member of its bucket, in another component, that have enough in common as far as is known."""
        p = pivots.select("key", *[F.col(c).alias("p_" + c) for c in pivots.columns if c != "key"])
        least = F.least("reach", "p_reach", F.when(F.col("p_end") <= F.col("end"), F.col("p_shared")).otherwise(F.col("p_n")), F.when(F.col("end") <= F.col("p_end"), F.col("shared")).otherwise(F.col("n")))
        found = own.join(p, (own["key"] == p["key"]) & (F.col("p_id") != F.col("id")) & (F.col("p_c") != F.col("c")) & (denominator * least >= numerator * (F.col("n") + F.col("p_n") - least)) & among)
        return found.select(F.col("p_id").alias("a"), F.col("id").alias("b")).distinct()

    ids = staged(buckets.select(F.col("id").alias("doc_id")).distinct())
    marks = staged(rows.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "parity").dropDuplicates(["id"]))
    level = F.when(F.xxhash64(F.lit(3), "id") == 0, 63).otherwise(F.length(F.regexp_extract(F.bin(F.xxhash64(F.lit(3), "id")), "0*$", 0)))
    members = buckets.join(nodes, "id").select("key", "id", "n", "shared", "end", "degree", "reach", level.alias("level"))
    # A member that is not early needs an early one of a size at which its reach suffices.
    early = F.col("reach") * (numerator + denominator) >= 2 * numerator * F.col("n")
    least = members.groupBy("key").agg(F.min(F.when(early, F.col("n"))).alias("least")).where("least is not null")
    suffices = numerator * F.greatest(denominator * F.col("least"), numerator * F.col("n")) <= denominator * (F.col("reach") * (numerator + denominator) - numerator * F.col("n"))
    members = staged(members.join(least, "key").where(early | suffices).drop("least"))
    whole, step = None, 0
    own = members.withColumn("c", F.col("id"))
    while True:
        best = F.struct((F.col("shared") - F.col("n")).alias("central"), "degree", "id", "n", "shared", "end", "reach", "c")
        mixed = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.max("level").alias("top"), F.max(best).alias("best")).where("lo < hi")
        if step == 0:
            new = pairs(own, mixed.select("key", "best.id", "best.n", "best.shared", "best.end", "best.reach", "best.c"), F.lit(True))
        else:
            # below `late` levels from its bucket's top a member was a pivot before; `late` grows, so the pivots of a bucket multiply
            late, next_ = LEVELS * (step - 1), LEVELS * step
            mixed = mixed.where((F.col("size") > 2) & ((F.lit(step) == 1) | (F.col("size") > SMALL_BUCKET) & (F.col("top") >= late)))
            open_ = staged(own.join(mixed.select("key", (F.col("size") <= SMALL_BUCKET).alias("small"), "top"), "key").withColumn("depth", F.when(F.col("small"), 0).otherwise(F.col("top") - F.col("level"))).where(F.col("depth") >= late))
            if open_.isEmpty():
                return whole
            new = pairs(open_, open_.where(F.col("small") | (F.col("depth") < next_)), (F.col("depth") >= next_) | (F.col("p_id") < F.col("id")))
        fresh = _linked(new, docs, marks, span, numerator, denominator)
        step += 1
        if whole is not None and fresh.isEmpty():
            continue
        if whole is None:
            whole = staged(components(fresh))
        else:  # new links join components that are there already
            x, y = whole.select(F.col("id").alias("a"), F.col("component").alias("x")), whole.select(F.col("id").alias("b"), F.col("component").alias("y"))
            moved = components(fresh.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            known = whole.unionByName(fresh.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(whole, "id", "left_anti").select("id", F.col("id").alias("component")))
            whole = staged(known.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        own = staged(members.join(whole.select("id", F.col("component").alias("w")), "id", "left").select("key", "id", "n", "shared", "end", "degree", "reach", "level", F.coalesce("w", "id").alias("c")))


def jaccard_components(docs: DataFrame, span: int = SPAN, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, slices = _sets(docs, span)
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entries = staged(_entries(docs, span, _classes(slices, tokens), numerator, denominator))
    buckets, nodes = _buckets(entries, numerator, denominator)
    release(docs.sparkSession)
    linked = _links(docs, rows, buckets, nodes, span, numerator, denominator)
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # one text may have any share of the rows, so its copies meet their class in SALTS parts
    classes = classes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = rows.select("doc_id", "n", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    own = staged(salted.join(classes, ["digest", "salt"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    # Indexed documents of one class are in one component, as they link with each other.
    of = linked.join(own.select(F.col("doc_id").alias("id"), "rep"), "id")
    least = of.groupBy("component").agg(F.min("rep").alias("least"))
    whole = of.select("rep", "component").distinct().join(least, "component").groupBy("rep").agg(F.min("least").alias("least"))
    return own.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id"))


def representatives(docs: DataFrame, span: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs without the rows that are not the least doc_id of their component. Rows without a doc_id stay."""
    copies = staged(jaccard_components(docs, span, numerator, denominator).where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(few(copies), "doc_id", "left_anti").select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 4 THEN len(w)::VARCHAR || ':' ELSE '' END || array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
