"""Counts, files and packing against the tokenizers library itself."""

import glob
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import encoding, packing, token_counts, token_files
from rasterloom.llm.common import shared_folder, staged
from rasterloom.llm.encoding import Encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "\n\n a", "don't  stop'll ''s '", "²³½x", "<|endoftext|> a<|startoftext|>", "Ünï ÇODE İx ß́", "a\xa0 b c", "日本語 text", "a\x1cb", "ªº µ", "x" * 3000, "!!'s", "'S 'RE", "\r\n\t x ", "<|endoftext"]


@pytest.fixture(scope="module", params=NAMES)
def enc(request):
    return Encoder(request.param)


def whole(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(enc, text):
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole(enc, text)
    assert enc.count(text) == len(whole(enc, text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(list(" \n'sdm!.,09é²"))), max_size=60))
def test_any_text(text):
    for name in NAMES:
        e = _ENC.setdefault(name, Encoder(name))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == whole(e, text)
        assert e.count(text) == len(whole(e, text))
        assert [np.frombuffer(x, "<u4").tolist() for x in e.column(pa.array([text, None, "ab", text]))] == [whole(e, text), [], whole(e, "ab"), whole(e, text)]


_ENC: dict = {}


@pytest.mark.parametrize("name", NAMES)
def test_sure_texts_need_the_model_alone(name, monkeypatch):
    """Every character whose cut is certain, in words and between them, without the library's way for whole texts."""
    e, sure = Encoder(name), [chr(c) for c in range(encoding.LAST + 1) if not encoding.UNSURE.search(chr(c))]
    texts = [f"{c} a{c}b{c} {c}7.{c},Z" for c in sure] + ["word. word, Word", "a" * 400, "don't!!'ll"]
    want = [whole(e, t) for t in texts]
    monkeypatch.setattr(e, "whole", None)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.ids_all(texts)] == want
    assert [e.count(t) for t in texts] == [len(x) for x in want]


def test_long_words_take_more_of_a_cache():
    cache = encoding.Cache({}, str.upper, 100)
    for k in range(1000):
        assert cache[f"{k:0250}"] == f"{k:0250}" and len(cache) + len(cache.before) <= 8
    assert [cache[f"w{k}"] for k in range(40)] == [f"W{k}" for k in range(40)] and len(cache) >= 40


def test_a_column_looks_each_string_up_once():
    """Copies, marks after words, letters and spaces beyond ASCII, null, odd texts; whole columns, slices, large strings, no rows."""
    e, looked, made = Encoder(NAMES[1]), [], []

    class Watched(encoding.Cache):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    e._ids = Watched({}, e.chunk)
    model = e.model
    e.model = lambda w: made.append(w) or model(w)
    texts = ["The cat, the CAT.\tthe\r\ncat,"] * 50 + [None, "", " \n", "\xa0ÀÉ\xa0 É, ×ß", "don't don't, ''s 12.5% (x)", "x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.column(pa.array(texts))] == [whole(e, t) for t in texts]
    assert looked.count("the") == 1 and looked.count("cat,") == 1 and made.count("cat") == 1 and len(looked) < 50 and len(made) == len(set(made))
    texts += [*ODD, None, *ODD]
    want = [whole(e, t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.column(column)] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in e.column(column.slice(40, 30))] == want[40:70]
        assert e.column(column.slice(0, 0)) == [] and e.column(pa.array([None, " "], kind)) == [b"", b""]


def test_file_workers_keep_the_words_of_many_batches():
    e = encoding.encoder(NAMES[1], token_files.HELD)
    texts = pa.array([" ".join(f"q{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}{'klmnopqrst'[k // 260 % 10]}{'uvwxyzabcd'[k // 2600 % 10]}{'efghijklmn'[k // 26000]}" for k in range(lo, lo + 10_000)) for lo in range(0, 120_000, 10_000)])
    made, model = [], e.model
    e.model = lambda w: made.append(w) or model(w)
    try:
        for _ in range(2):
            for k in range(len(texts)):
                e.column(texts.slice(k, 1))
    finally:
        e.model = model
    assert len(made) == len(set(made)) == 120_000


def test_what_comes_again_stays_in_the_cache(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 20)
    made = []
    cache = encoding.Cache({"known": "KNOWN"}, lambda w: made.append(w) or w.upper())
    for k in range(100):
        assert [cache[w] for w in ("hot", f"w{k}", "known", "x" * 300)] == ["HOT", f"W{k}", "KNOWN", "X" * 300]
        assert len(cache) + len(cache.before) <= 23
    assert made.count("hot") == 1 and "known" not in made


def test_token_counts(docs, corpus, no_docs):
    e = Encoder(NAMES[0])
    rows = token_counts.token_counts(docs, NAMES[0]).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((i, len((t or "").encode()), n := len(whole(e, t)), n > 1024) for i, t in corpus)
    assert token_counts.token_counts(no_docs, NAMES[0]).count() == 0


def test_table_has_the_most_frequent_of_all_texts(spark, monkeypatch):
    """Words that only late texts hold, in one partition and beyond any first batch; many partial counts; a table too small for all."""
    rng = random.Random(5)
    texts = ["early words only"] * 200 + [" ".join(rng.choices(["late", "rare", *(f"x{k}y" for k in range(200))], [90, 4] + [1] * 200, k=12)) for _ in range(2300)] + [None, "日 late", "z" * 100, "once"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    cut = encoding.pieces_of(NAMES[0])
    want = Counter(w for t in texts for w in cut(t or "") or [])
    monkeypatch.setattr(token_counts, "HELD", 20)
    for size in (1 << 15, 40):
        monkeypatch.setattr(token_counts, "TABLE", size)
        words, lengths = token_counts.frequent(rows, NAMES[0])
        table = words.decode().split("\0")
        assert " late" in table and len(set(table)) == len(table) == len(lengths) <= size
        left = [n for w, n in want.items() if w not in table and len(w) <= token_counts.LONGEST]
        assert min(want[w] for w in table) > max(left)
        assert size < 100 or max(left) == 1
    monkeypatch.setattr(token_counts, "TABLE", 0)
    assert token_counts.frequent(rows, NAMES[0]) == (b"", b"")


def test_token_files(spark, docs, corpus, no_docs):
    e, path = Encoder(NAMES[1]), shared_folder(spark)
    rows = {r.doc_id: r for r in token_files.read_tokens(token_files.write_tokens(docs, path)).collect()}
    at = 0
    for i, t in sorted(corpus):
        ids = np.array([*whole(e, t), 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    files = [pq.ParquetFile(f) for f in glob.glob(path.removeprefix("file://") + "/*.parquet")]
    column = next(f for f in files if f.metadata.num_rows).metadata.row_group(0)
    by_name = {column.column(k).path_in_schema.split(".")[0]: column.column(k) for k in range(column.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings and by_name["ids"].has_dictionary_page
    assert by_name["doc_id"].has_column_index and by_name["doc_id"].has_offset_index
    assert token_files.read_tokens(token_files.write_tokens(no_docs, shared_folder(spark))).count() == 0


def test_token_files_keep_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (2, None)], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(token_files.write_tokens(rows, shared_folder(spark))).collect())
    assert [s for s, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()]


def check_packed(rows, width):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= width
    return len(by)


@pytest.mark.parametrize("joined", [False, True])
def test_packing(docs, corpus, joined, monkeypatch):
    if joined:
        monkeypatch.setattr(packing, "PLAN_BYTES", 0)
    e = Encoder(NAMES[1])
    rows = packing.pack(staged(packing.pieces(docs))).collect()
    want = []
    for i, t in corpus:
        ids = np.array([*whole(e, t), 1], "<u4")
        want += [(i, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 4096)) for p in (ids[k * 4096 : (k + 1) * 4096],)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_packed(rows, 4096) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_of_odd_rows(spark, no_docs):
    assert packing.pack(staged(packing.pieces(no_docs))).count() == 0
    rows = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert check_packed(packing.pack(staged(packing.pieces(rows))).collect(), 4096) == 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_best_fit_is_what_one_by_one_gives(histogram):
    """Every piece gets one slot, and as many sequences are used as by best fit decreasing piece by piece."""
    plan = packing.best_fit(histogram, 50)
    slots = [(length, r, s + r - first, off) for length, first, n, s, off in plan for r in range(first, first + n)]
    assert sorted((length, r) for length, r, _, _ in slots) == sorted((length, r) for length, n in histogram.items() for r in range(n))
    by = {}
    for length, _, s, off in slots:
        by.setdefault(s, []).append((off, length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 50
    space = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        k = min((i for i, s in enumerate(space) if s >= length), key=lambda i: space[i], default=None)
        if k is None:
            space.append(50 - length)
        else:
            space[k] -= length
    assert len(by) == len(space)


def test_a_sequence_is_filled_before_the_next_of_its_run():
    """Few lengths that dominate: one piece for each sequence of a run would fragment their space."""
    for histogram, width, want in [({2458: 14, 819: 14, 532: 21}, 4096, 14), ({4: 13, 11: 1, 36: 31, 40: 30, 7: 38, 8: 40}, 50, 61)]:
        plan = packing.best_fit(histogram, width)
        assert len({s + i for _, _, n, s, _ in plan for i in range(n)}) == want


def test_plan_grows_with_lengths_not_texts():
    rng = random.Random(2)
    small = {n: rng.randrange(1, 50) for n in range(1, 2000)}
    assert len(packing.best_fit({k: v * 1_000_000 for k, v in small.items()})) < 4 * len(packing.best_fit(small))
