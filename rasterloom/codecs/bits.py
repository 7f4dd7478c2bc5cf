"""Bits, least significant first, as the lossless format has them."""

from __future__ import annotations

import numpy as np


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """n <= 32 bits; zeros beyond the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 6], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise EOFError("bits beyond the end")

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v


class BitWriter:
    """Collects (value, bits) pairs, single or as arrays, and packs them all at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def write(self, value: int, n: int) -> None:
        self.extend(np.array([value], np.int64), np.array([n], np.int64))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values.astype(np.int64).ravel())
        self.sizes.append(sizes.astype(np.int64).ravel())

    def bytes(self) -> bytes:
        if not self.values:
            return b""
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        at = np.cumsum(n) - n
        bits = np.zeros(int(n.sum()), np.uint8)
        for k in range(int(n.max(initial=0))):
            own = n > k
            bits[at[own] + k] = v[own] >> k & 1
        return np.packbits(bits, bitorder="little").tobytes()
