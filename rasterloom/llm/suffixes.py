"""Suffix sort by hash comparison, vectorised: prefix polynomial hashes, binary search for common extensions, mergesort.

Strings are pieces of one byte array, each with an anchor. Extensions of two anchors, to the right or to the left, are compared by
the longest length at which their polynomial hashes agree (a binary search, so logarithmic) and the byte after it. Runs are merged by
searching each element's place in its sibling run, all elements at once. The common lengths of neighbours in the result are then
verified byte by byte; a hash collision makes the piece be sorted by its bytes instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BASE = 0x9E3779B97F4A7C15
_GROWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if base not in _GROWN or len(_GROWN[base][0]) < size:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(size, 1 << 12), b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _GROWN[base] = (out[0], out[1])
    return _GROWN[base]


class PrefixHash:
    """hash(at, length) of any part of data, equal for equal parts wherever they stand."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        up, self.down = powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]


class Extensions:
    """Comparison of what follows (step 1) or precedes (step -1) the anchors, up to `most` bytes each."""

    def __init__(self, data: np.ndarray, hashes: PrefixHash, anchor: np.ndarray, most: np.ndarray, step: int):
        self.data, self.hashes, self.anchor, self.most, self.step = data, hashes, anchor, most, step
        self.bits = int(max(1, int(most.max(initial=1)))).bit_length()

    def common(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(u), np.int64), np.minimum(self.most[u], self.most[v])
        a, b = self.anchor[u], self.anchor[v]
        for _ in range(self.bits):
            mid = (low + high + 1) >> 1
            back = mid if self.step < 0 else 0
            same = self.hashes(a - back, mid) == self.hashes(b - back, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def byte(self, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte at distance k, or -1 beyond the end."""
        at = self.anchor[u] + k if self.step > 0 else self.anchor[u] - 1 - k
        return np.where(k < self.most[u], self.data[np.clip(at, 0, len(self.data) - 1)].astype(np.int16), np.int16(-1))

    def before(self, u: np.ndarray, v: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether u sorts before v; `equal` says what to answer where they are the same."""
        k = self.common(u, v)
        x, y = self.byte(u, k), self.byte(v, k)
        return (x < y) | (x == y) & equal

    def bytes(self, u: int) -> bytes:
        a, n = int(self.anchor[u]), int(self.most[u])
        return self.data[a : a + n].tobytes() if self.step > 0 else self.data[a - n : a][::-1].tobytes()

    def verified(self, u: np.ndarray, v: np.ndarray, k: np.ndarray) -> bool:
        """Whether u and v really agree in k bytes and not in one more."""
        for i in range(0, len(u), 1 << 14):
            a, b, n = u[i : i + (1 << 14)], v[i : i + (1 << 14)], k[i : i + (1 << 14)]
            far = np.arange(int(n.max(initial=0)) + 1)[None]
            x, y = self.byte(a[:, None], np.broadcast_to(far, (len(a), far.shape[1]))), self.byte(b[:, None], np.broadcast_to(far, (len(a), far.shape[1])))
            if ((x != y) & (far < n[:, None])).any():
                return False
            rows = np.arange(len(a))
            if ((x[rows, n] == y[rows, n]) & (x[rows, n] >= 0)).any():
                return False
        return True


def mergesort(groups: np.ndarray, before: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Order of elements 0..n-1 sorted within their groups (ascending, contiguous); stable."""
    n = len(groups)
    order = np.arange(n)
    if not n:
        return order
    edge = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    size = np.diff(np.append(edge, n))
    first, end = np.repeat(edge, size), np.repeat(edge + size, size)
    slot, width = np.arange(n), 1
    while width < size.max():
        inside = slot - first
        base = first + inside // (2 * width) * (2 * width)
        right = (inside // width) & 1 == 1
        low = np.where(right, base, np.minimum(base + width, end))
        high = np.where(right, base + width, np.minimum(base + 2 * width, end))
        start = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            # an element of the right run comes after its equals in the left run, so that the order is stable
            less = before(order[mid], order[todo], right[todo])
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = np.where(right, slot - base - width, slot - base) + base + (low - start)
        new = np.empty(n, np.int64)
        new[place] = order
        order, width = new, 2 * width
    return order


def sorted_extensions(ext: Extensions, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order within groups, bytes that each shares with the one before it; -1 at a group's first)."""
    order = mergesort(groups, ext.before)
    shared = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    shared[inner] = ext.common(order[inner - 1], order[inner])
    if not ext.verified(order[inner - 1], order[inner], shared[inner]):  # a collision: compare the bytes themselves
        order = np.array(sorted(range(len(groups)), key=lambda u: (groups[u], ext.bytes(u), u)), np.int64)
        for i in inner:
            x, y = ext.bytes(order[i - 1]), ext.bytes(order[i])
            shared[i] = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return order, shared
