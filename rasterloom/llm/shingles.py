"""Sets of word shingles as sorted 64-bit hashes, made for whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text) of texts data[at[k] : at[k + 1]]; A-Z count as a-z, white space separates."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = np.zeros(size + 8, np.uint8)
    low[:size] = _LOWER[data]
    word = _WORD[data]
    first = np.zeros(size + 1, bool)
    first[at] = True
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    starts = np.flatnonzero(word & (~before | first[:-1]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    eight = np.ndarray((size + 1,), "<u8", low, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * _G)
    todo, places = np.arange(len(starts)), starts.copy()
    while len(todo):
        part = eight[places] & _MASK[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ part) * _G + part)
        more = left > 8
        todo, places, left = todo[more], places[more] + 8, left[more] - 8
    return out, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, span: int) -> list[np.ndarray]:
    """For each text its distinct shingles of `span` words as ascending hashes; with fewer words the whole sequence is one."""
    words, upto = word_hashes(data, at)
    n = len(words) - span + 1
    if n > 0:
        whole = words[:n].copy()
        for k in range(1, span):
            whole = mix(whole * _G + words[k : n + k])
    out = []
    for i, j in zip(upto[:-1], upto[1:]):
        if j - i >= span:
            out.append(np.unique(whole[i : j - span + 1]))
        elif j > i:
            h = words[i : i + 1].copy()
            for w in words[i + 1 : j]:
                h = mix(h * _G + w)
            out.append(mix(h + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
