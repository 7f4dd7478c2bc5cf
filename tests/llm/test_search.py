"""Decontamination, suffix dedup and the n-gram join against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import decontaminate, ngram_join, repeats
from rasterloom.llm.components import components
from rasterloom.llm.shingles import shingle_sets
from rasterloom.llm.suffixes import Extensions, PrefixHash, sorted_extensions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_hits(text, items):
    w = WORD.findall(lower(text))
    hit, ids = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        n = min(13, len(v))
        own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in own:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="session")
def items(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 60]
    return [(k, " ".join(t.split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(texts, (13, 14, 40, 12, 5, 1, 30, 22)))] + [(90, "Ünï-code, 3 Ünï!"), (91, ""), (92, None), (93, "--"), (93, texts[0][:80])]


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontamination(spark, docs, corpus, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.with_hits(docs.select("doc_id", "text"), bench).select("doc_id", "__hits", decontaminate.n_hit().alias("n"), decontaminate.is_contaminated().alias("c")).collect()
    texts = dict(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        n, hit, ids = plain_hits(texts[r.doc_id], items)
        assert (r["__hits"].n_words, r.n, r["__hits"]["items"]) == (n, hit, ids)
        assert r.c == (hit > 0 and 20 * hit >= n)
        for s in r["__hits"].spans:
            part = texts[r.doc_id].encode()[s.start : s.end].decode()
            assert WORD.findall(lower(part)) and part == part.strip()
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns


def test_decontamination_of_nothing(spark, no_docs, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, bench).count() == docs.count()
    assert decontaminate.decontaminated(no_docs, bench).count() == 0


def plain_repeats(corpus, length=100):
    seen, out = set(), {}
    for doc, text in sorted(corpus):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "local", "chunk", "members"), [(1 << 16, 256, 1 << 20, 40_000), (1, 256, 1 << 20, 40_000), (1 << 16, 1, 1 << 20, 40_000), (6, 5, 3000, 50)])
def test_repeats(docs, corpus, hot, local, chunk, members, monkeypatch):
    """The gathered, the hot and the locally hot way give what a plain scan gives, whatever the sizes of chunks."""
    own = dict(HOT=hot, LOCAL=local, CHUNK=chunk, MEMBERS=members)
    for k, v in own.items():
        monkeypatch.setattr(repeats, k, v)
    rows = repeats_with(docs, own)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain_repeats(corpus)


def repeats_with(docs, own):
    """The workers import the module anew; the values travel in the functions."""
    kept = {n: getattr(repeats, n) for n in ("_rows", "_local", "_sorted")}

    def with_values(f):
        def g(rows):
            from rasterloom.llm import repeats as module

            for k, v in own.items():
                setattr(module, k, v)
            yield from f(rows)

        return g

    try:
        for n, f in kept.items():
            setattr(repeats, n, with_values(f))
        return repeats.without_repeats(docs).collect()
    finally:
        for n, f in kept.items():
            setattr(repeats, n, f)


def test_repeats_of_odd_rows(spark, no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
    text = "abcdefghij" * 11 + "".join(map(str, range(200)))
    rows = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.without_repeats(rows).collect())
    inside = plain_repeats([(1, text)])[1][1]
    assert got == [(0, 0), (0, 0), (1, inside), (1, inside), (2, len(text))]


def test_suffix_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    anchor = np.sort(rng.integers(0, 4000, 500))
    groups = np.sort(rng.integers(0, 40, 500))
    for step, most in ((1, np.minimum(60, 4000 - anchor)), (-1, np.minimum(60, anchor))):
        ext = Extensions(data, PrefixHash(data), anchor, most, step)
        order, shared = sorted_extensions(ext, groups)
        assert order.tolist() == sorted(range(500), key=lambda u: (groups[u], ext.bytes(u), u))
        for i in range(1, 500):
            if groups[i] == groups[i - 1]:
                x, y = ext.bytes(order[i - 1]), ext.bytes(order[i])
                k = 0
                while k < min(len(x), len(y)) and x[k] == y[k]:
                    k += 1
                assert shared[i] == k


def test_suffix_sort_survives_collisions():
    """With a base that makes all parts of one length and sum equal, the bytes decide."""
    data = np.array([1, 2, 2, 1, 1, 2, 2, 1, 3, 0], np.uint8)
    weak = PrefixHash(data, base=1)
    ext = Extensions(data, weak, np.array([0, 2, 4, 6]), np.array([2, 2, 2, 2]), 1)
    order, shared = sorted_extensions(ext, np.zeros(4, np.int64))
    assert [ext.bytes(u) for u in order] == sorted(ext.bytes(u) for u in range(4)) and shared.tolist()[1:] == [2, 0, 2]


def plain_components(corpus, span, num, den):
    sets = {}
    for doc, text in corpus:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
        sets[doc] = {tuple(w[i : i + span]) for i in range(max(1, len(w) - span + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(
    ("span", "num", "often", "sizes", "bucket"),
    [(4, 85, None, (64, 384), 32), (5, 80, None, (64, 384), 32), (4, 85, 4, (64, 384), 2), (4, 85, 4, (0, 110), 2), (4, 85, 1, (110, 150), 2), (2, 60, 2, (20, 40), 2)],
)
def test_ngram_join(docs, corpus, span, num, often, sizes, bucket, monkeypatch):
    """Also where a low bound makes tokens frequent, so that combinations, long sets and rounds of pivots are used."""
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", bucket)
    if often:
        counts = Counter()
        for s in shingle_sets(*bytes_of(corpus), span):
            counts.update((s & np.uint64(ngram_join.WIDTH - 1)).tolist())
        classes = np.zeros(ngram_join.WIDTH, np.uint8)
        for k, n in counts.items():
            classes[k] = 0 if n <= often else min(15, 1 + int(np.log2(n / often)))
        monkeypatch.setattr(ngram_join, "_classes", lambda slices, tokens: (classes[::2] | classes[1::2] << 4).tobytes())
    plain = ngram_join.index_entries

    def entries(tokens, classes, numerator, denominator):
        from rasterloom.llm import ngram_join as module

        module.SIZES, module.HIGH = {3: sizes[0], 2: sizes[1]}, 2
        return plain(tokens, classes, numerator, denominator)

    monkeypatch.setattr(ngram_join, "SIZES", {})
    monkeypatch.setattr(ngram_join, "HIGH", 2)
    monkeypatch.setattr(ngram_join, "index_entries", entries)
    rows = ngram_join.jaccard_components(docs, span, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(corpus, span, num, 100)


@pytest.mark.parametrize("sizes", [{3: 64, 2: 384}, {3: 20, 2: 30}, {3: 0, 2: 0}, {3: 40, 2: 40}])
def test_linked_sets_meet_in_an_entry(sizes, monkeypatch):
    """Whatever the classes: an entry in common at which neither's reach is below what they need."""
    monkeypatch.setattr(ngram_join, "SIZES", sizes)
    rng, linked = np.random.default_rng(7), 0
    for _ in range(1500):
        pool = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 60))).astype(np.uint64))
        x, y = (pool[rng.random(len(pool)) < rng.choice([1.0, 0.97, 0.9])] for _ in range(2))
        both = len(np.intersect1d(x, y))
        num = int(rng.choice([60, 80, 85]))
        if not both or 100 * both < num * (len(x) + len(y) - both):
            continue
        linked += 1
        kind = dict(zip(pool.tolist(), rng.integers(0, int(rng.integers(1, 9)), len(pool)).tolist()))
        found = []
        for s in (x, y):
            a, ra, c, rc = ngram_join.index_entries(s, np.array([kind[t] for t in s.tolist()], np.uint8), num, 100)
            best = {}
            for k, r in [*zip(a.tolist(), ra.tolist()), *zip(c.tolist(), rc.tolist())]:
                best[k] = max(best.get(k, 0), r)
            found.append(best)
        reach = max((min(found[0][k], found[1][k]) for k in found[0].keys() & found[1].keys()), default=0)
        assert x.tobytes() == y.tobytes() or reach * (100 + num) >= num * (len(x) + len(y))
    assert linked > 200


def test_a_family_just_outside_the_threshold_gives_few_candidates(spark, monkeypatch):
    """400 versions of one text, each with three words of its own: no two link, and pairs don't grow with the square of the family."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        w = list(base)
        for k in rng.sample(range(4, 146), 3 if i > 40 else 1):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    tested, plain = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *a: (tested.append(pairs.count()), plain(pairs, *a))[1])
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {d: c for d, (_, c) in plain_components(rows, 4, 85, 100).items()}
    assert sum(tested) < 5 * len(rows)


def test_parity_rules_out_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert ngram_join.may_link(ngram_join.parity_of(x), ngram_join.parity_of(y), len(x) + len(y), 85, 100)
    far = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2)]
    assert not ngram_join.may_link(*map(ngram_join.parity_of, far), 600, 85, 100)


def bytes_of(corpus):
    parts = [(t or "").encode() for _, t in corpus]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def test_ngram_join_of_odd_rows(spark, no_docs, docs):
    assert ngram_join.jaccard_components(no_docs).count() == 0
    assert ngram_join.representatives(no_docs).count() == 0
    t = " ".join(f"a{i}" for i in range(50))
    rows = spark.createDataFrame([(None, t, 1), (4, t, 2), (4, t, 2), (9, t, 3), (10, None, 4)], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(rows).collect())
    assert got == [(0, 4), (4, 4), (4, 4), (9, 4), (10, 10)]
    kept = ngram_join.representatives(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 10]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 400)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2)) if a != b] + [(5, k) for k in range(2000, 2100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == root
