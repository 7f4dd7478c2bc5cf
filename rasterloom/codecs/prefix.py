"""Prefix codes of the lossless format: length-limited lengths, canonical codes, and how they are written and read."""

from __future__ import annotations

import heapq

import numpy as np

from .bits import BitReader, BitWriter

MOST = 15
#: Order in which the lengths of the code-length code are stored (fixed values).
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def limited_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge). One used symbol has length 1; unused ones 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    leaves = sorted((int(counts[s]), (int(s),)) for s in used)
    merged: list = []
    for _ in range(most):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2])]
        merged = list(heapq.merge(leaves, pairs, key=lambda p: p[0]))
    for _, symbols in merged[: 2 * len(used) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol), bit-reversed as they are written."""
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return out


class Decoder:
    """A table from the next bits to (symbol, length). No used symbol reads as 0, one takes no bits."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        self.alone = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        if self.alone is not None:
            return
        self.bits = int(lengths.max())
        self.symbol, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)
        codes = canonical(lengths)
        for s in used:
            n = int(lengths[s])
            if codes[s] < 1 << n:  # a code with too many words: those that don't fit are left out
                self.symbol[codes[s] :: 1 << n] = s
                self.size[codes[s] :: 1 << n] = n
        self.symbol, self.size = self.symbol.tolist(), self.size.tolist()

    def read(self, r: BitReader) -> int:
        if self.alone is not None:
            return self.alone
        k = r.peek(self.bits)
        n = self.size[k]
        if not n:
            raise ValueError("bits that are no code")
        r.skip(n)
        return self.symbol[k]


def read_lengths(r: BitReader, alphabet: int, keep_last: bool = False) -> np.ndarray:
    """Code lengths of an alphabet. keep_last: whether a run of zeros leaves the length that is repeated as it was (as the published
    format has it) instead of resetting it."""
    out = np.zeros(alphabet, np.int64)
    if r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)]
        if two:
            symbols.append(r.read(8))
        for s in symbols:
            if s >= alphabet:
                raise ValueError("symbol outside the alphabet")
            out[s] = 1
        return out
    own = np.zeros(19, np.int64)
    for k in range(4 + r.read(4)):
        own[ORDER[k]] = r.read(3)
    code = Decoder(own)
    left = alphabet
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
    at, last = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(r)
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
            continue
        n = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
        out[at : at + n] = last if s == 16 else 0  # what runs beyond the alphabet is left out
        at += n
        if s > 16 and not keep_last:
            last = 0
    return out


def write_lengths(w: BitWriter, lengths: np.ndarray) -> None:
    """Simple form for at most two symbols below 256, else runs coded by a second code. Repeats only follow a written length."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.write(1, 1)
        w.write(len(symbols) - 1, 1)
        w.write(int(symbols[0] > 1), 1)
        w.write(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.write(symbols[1], 8)
        return
    w.write(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    while at < len(lengths):
        v, end = int(lengths[at]), at
        while end < len(lengths) and lengths[end] == v:
            end += 1
        n = end - at
        if v:
            tokens.append((v, 0, 0))
            n -= 1
        while n:
            if v and n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
            elif not v and n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
            elif not v and n >= 3:
                k = min(n, 10)
                tokens.append((17, k - 3, 3))
            else:
                k = 1
                tokens.append((v, 0, 0))
            n -= k
        at = end
    own = limited_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(own)
    most = max(4, max(k + 1 for k in range(19) if own[ORDER[k]]))
    w.write(most - 4, 4)
    for k in range(most):
        w.write(int(own[ORDER[k]]), 3)
    w.write(0, 1)
    alone = np.count_nonzero(own) == 1
    for s, extra, n in tokens:
        if not alone:
            w.write(int(codes[s]), int(own[s]))
        if n:
            w.write(extra, n)
