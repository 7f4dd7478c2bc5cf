"""Exact token ids and counts through a cache of pre-tokens in each worker.

A text is cut into pre-tokens by the tokenizer's own published pattern; a pre-token's ids come from the library's model and are
kept. That equals encoding the whole text wherever the cut is certain: texts of characters up to U+012F without control
characters or the tokenizer's special strings. Every other text is given whole to the library.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

#: What the cut is not certain for: other scripts, combining marks, controls, special strings.
LAST = 0x12F
UNSURE = re.compile(rf"[^\t-\r\x20-\x7e\xa0-{chr(LAST)}]|<\|")


def _of(kind: str) -> str:
    """The characters up to LAST of a general category, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(LAST + 1) if unicodedata.category(chr(c))[0] == kind)


#: The published patterns of the two vocabularies for characters up to LAST; letters first, as most pre-tokens are words.
_L, _N, _SHORT = _of("L"), _of("N"), "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_BPE = rf" ?[{_L}]+| ?[{_N}]+|{_SHORT}| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
WORD_BPE = rf"[{_L}]+|[{_N}]|{_SHORT}|[^\s{_L}{_N}]+"
PATTERNS = {"byte_bpe_50k.json": (BYTE_BPE, False), "word_bpe_49k.json": (WORD_BPE, True)}

#: Both vocabularies spell bytes: printable ones as the character of that number, the others as characters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLING = dict(zip((b for b in range(256) if b not in _PRINTED), range(0x100, 0x200)))
STOPS = punctuation.replace("'", "")  # after letters these are one pre-token

CACHE = 150_000  # pre-tokens that a cache keeps beside those it was given
LONG, WIDE = 256, 16  # characters of a pre-token: beyond LONG it is not kept, and each WIDE of them take the place of another, so that CACHE bounds bytes as well


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of UTF-8 that stand in no sure text; some sure ones (U+0100 on) are among them, and go the slow way as well.
_DOUBT = np.zeros(256, bool)
_DOUBT[[*range(9), *range(14, 32), 127, *range(0xC4, 256)]] = True


def unsure_rows(data: np.ndarray, at: np.ndarray) -> set[int]:
    """Numbers of texts data[at[k] : at[k + 1]] that UNSURE may match; all that it does match are among them."""
    bad = [np.flatnonzero(_DOUBT[data])]
    for first, second in ((0xC2, lambda b: b < 0xA0), (0x3C, lambda b: b == 0x7C)):  # C1 controls; <|
        k = np.flatnonzero(data[:-1] == first)
        bad.append(k[second(data[k + 1])])
    return set((np.searchsorted(at, np.concatenate(bad), side="right") - 1).tolist())


def spelled(word: str) -> str:
    """A pre-token in the characters that the vocabularies have for its bytes."""
    return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(_SPELLING)


def strings(words: pa.Array) -> list[str]:
    """words.to_pylist() of strings without spaces, in a fraction of the time where they are no large ones, which Arrow can't join."""
    if not len(words) or pa.types.is_large_string(words.type):
        return words.to_pylist()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class Cache(dict):
    """pre-token -> value; a miss is encoded by the library and kept. What was not met while half as many others as it may hold came is forgotten. Each WIDE characters count as one more, which bounds bytes."""

    def __init__(self, known: dict, make: Callable[[str], object], held: int | None = None):
        super().__init__(known)
        self.known, self.make, self.before, self.half, self.used = known, make, {}, (held or CACHE) // 2, 0

    def __missing__(self, word: str) -> object:
        value = self.before.pop(word, None)
        if value is None:
            value = self.make(word)
        if len(word) <= LONG:
            if self.used >= self.half:
                self.before = dict(self)
                self.clear()
                self.update(self.known)
                self.used = 0
            self[word] = value
            self.used += 1 + len(word) // WIDE
        return value


def pieces_of(name: str) -> Callable[[str], list[str] | None]:
    """The pre-tokens of a text for a tokenizer, or None where the library has to see the whole text."""
    pattern, lower = PATTERNS[name]
    cut = re.compile(pattern).findall
    return lambda text: None if UNSURE.search(text) else cut(text.lower() if lower else text)


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes; count(text) as a number. known: pre-token -> count, may be empty. held: what a cache holds, if not CACHE."""

    def __init__(self, name: str, known: dict[str, int] | None = None, path: str | None = None, held: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pattern, self.lower = PATTERNS[name]
        self.cut = re.compile(pattern).findall
        self.unsure = UNSURE.search
        self.model = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self._ids = Cache({}, self.chunk if self.lower else self.word, held)
        self._counts = Cache(known or {}, lambda w: len(self.model(spelled(w))), held)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def word(self, word: str) -> bytes:
        """The ids of one pre-token, which the library's model takes as it is: what normalises and cuts texts is left out, as nothing is left to do."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model(spelled(word))])

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the library has to see the whole text."""
        return None if self.unsure(text) else self.cut(text.lower() if self.lower else text)

    def ids(self, text: str) -> bytes:
        return self.ids_all([text])[0]

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column. Where white space is dropped, each string between it is looked up once for the column."""
        unsure, texts = unsure_rows(*utf8(texts)), pc.fill_null(texts, "")
        if not self.lower:
            return self.ids_all(texts.to_pylist(), unsure)
        other = np.zeros(len(texts), bool)
        other[list(unsure)] = True
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(other), "", texts)))
        coded = chunks.flatten().dictionary_encode()
        found, code = list(map(self._ids.__getitem__, strings(coded.dictionary))), coded.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[code]
        end = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=end[1:])
        at = np.repeat((np.cumsum(size) - size)[code] - end[:-1], n)
        at += np.arange(end[-1])
        ids, bounds = np.frombuffer(b"".join(found), "<u4")[at], end[chunks.offsets.to_numpy()].tolist()
        return [self.whole(texts[k].as_py()).tobytes() if k in unsure else ids[i:j].tobytes() for k, (i, j) in enumerate(zip(bounds, bounds[1:]))]

    def ids_all(self, texts: list[str], unsure: set[int] | None = None) -> list[bytes]:
        """The ids of each text. Where white space is dropped, what stands between it is looked up as a whole."""
        if unsure is None:
            unsure = {k for k, t in enumerate(texts) if self.unsure(t)}
        known = self._ids.__getitem__
        return [self.whole(t).tobytes() if k in unsure else b"".join(map(known, t.lower().split() if self.lower else self.cut(t))) for k, t in enumerate(texts)]

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands between white space, which may be several pre-tokens."""
        if chunk.isalpha():
            return self.word(chunk)
        w = chunk.rstrip(STOPS)
        parts = [w, chunk[len(w) :]] if w.isalpha() else self.cut(chunk)
        return self.word(chunk) if parts == [chunk] else b"".join(map(self._ids.__getitem__, parts))

    def count(self, text: str) -> int:
        words = self.pieces(text)
        return len(self.whole(text)) if words is None else sum(map(self._counts.__getitem__, words))


@lru_cache(4)
def encoder(name: str, held: int | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(name, held=held)


def lists(ids: Iterable[bytes]):
    """An Arrow list<int32> column of such ids, without a Python object for each."""
    ids = list(ids)
    at = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))
