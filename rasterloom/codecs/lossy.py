"""The lossy stream (key frames): encoder and decoder for one picture.

The format's probability tables (coefficients, their updates, 4x4 modes) have about 3,000 entries and are a parameter: Tables.load
reads them from a JSON file. Without one a rule fills them, which serves streams written and read here; streams of other programs need
the published tables. Everything else follows the format: 16x16 and 4x4 prediction, second-order DC, segments, partitions, skipping,
token contexts, both loop filters. The encoder writes 16x16 modes, one segment, one partition and no loop filter.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np

from ..functions.blocks import AC_STEPS, BANDS, DC_STEPS, DIRECTIONS, ZIGZAG
from .riff import BadFile

DC, V, H, TM, B_PRED = range(5)
#: Probabilities of the key-frame mode trees and of the extra bits of token categories (fixed values).
Y_MODE, UV_MODE = (145, 156, 163, 128), (142, 114, 183)
EXTRA = ((159,), (165, 145), (173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
EXTRA_BASE = (5, 7, 11, 19, 35, 67)
#: 4x4 modes in the order of the format, and their tree: positive entries lead on, others are -mode.
MODES4 = ("DC", "TM", "VE", "HE", "RD", "VR", "LD", "VL", "HD", "HU")
TREE4 = (0, 2, -1, 4, -2, 6, 8, 12, -3, 10, -4, -5, -6, 14, -7, 16, -8, -9)
MOST_SIDE = 16383


@dataclass
class Tables:
    """coefficients and updates: 4 x 8 x 3 x 11; modes: 10 x 10 x 9 (above, left)."""

    coefficients: np.ndarray = field(default_factory=lambda: np.fromfunction(lambda p, b, c, n: np.clip(40 + 45 * c + 9 * (7 - b) + 8 * n, 1, 254), (4, 8, 3, 11)).astype(int))
    updates: np.ndarray = field(default_factory=lambda: np.full((4, 8, 3, 11), 250))
    modes: np.ndarray = field(default_factory=lambda: np.full((10, 10, 9), 128))

    @classmethod
    def load(cls, path: str) -> Tables:
        with open(path) as f:
            own = json.load(f)
        return cls(*(np.array(own[k]).reshape(s) for k, s in (("coefficients", (4, 8, 3, 11)), ("updates", (4, 8, 3, 11)), ("modes", (10, 10, 9)))))

    @classmethod
    def of_specification(cls, text: str) -> Tables:
        """From the text of the format's published specification (RFC 6386), whose C listings hold the tables by these names."""
        text = re.sub(r"/\*.*?\*/", " ", re.sub(r"(?m)^(?:RFC \d+ .*|.*\[Page \d+\]\s*)$", "", text), flags=re.S)
        found = []
        for name, shape in (("default_coeff_probs", (4, 8, 3, 11)), ("coeff_update_probs", (4, 8, 3, 11)), ("kf_bmode_probs?", (10, 10, 9))):
            m = re.search(name + r"\s*(?:\[[^\]]*\]\s*)+=\s*(\{[^;]*\})\s*;", text)
            numbers = re.findall(r"\d+", m[1]) if m else []
            if len(numbers) != np.prod(shape):
                raise ValueError(f"the text has no table {name} of {np.prod(shape)} numbers")
            found.append(np.array(numbers, int).reshape(shape))
        return cls(*found)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"coefficients": self.coefficients.tolist(), "updates": self.updates.tolist(), "modes": self.modes.tolist()}, f)


class BoolWriter:
    """Arithmetic coder of booleans whose probability of False is prob / 256."""

    def __init__(self):
        self.low, self.range, self.out, self.count = 0, 255, [], 24

    def put(self, bit: int, prob: int) -> None:
        split = 1 + ((self.range - 1) * prob >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            if self.low & 1 << 31:
                k = len(self.out) - 1
                while k >= 0 and self.out[k] == 255:
                    self.out[k] = 0
                    k -= 1
                self.out[k] += 1
                self.low &= (1 << 31) - 1
            self.low <<= 1
            self.count -= 1
            if not self.count:
                self.out.append(self.low >> 24)
                self.low &= (1 << 24) - 1
                self.count = 8

    def number(self, value: int, bits: int) -> None:
        for k in range(bits - 1, -1, -1):
            self.put(value >> k & 1, 128)

    def bytes(self) -> bytes:
        for _ in range(32):
            self.put(0, 128)
        return bytes(self.out)


class BoolReader:
    """The inverse. Beyond the end it reads zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.bits = data, 2, 255, 0
        self.value = int.from_bytes(data[:2].ljust(2, b"\0"), "big")

    def get(self, prob: int) -> int:
        split = 1 + ((self.range - 1) * prob >> 8)
        big = split << 8
        if self.value >= big:
            bit = 1
            self.range -= split
            self.value -= big
        else:
            bit = 0
            self.range = split
        while self.range < 128:
            self.value <<= 1
            self.range <<= 1
            self.bits += 1
            if self.bits == 8:
                self.bits = 0
                if self.at < len(self.data):
                    self.value |= self.data[self.at]
                    self.at += 1
        return bit

    def number(self, bits: int) -> int:
        v = 0
        for _ in range(bits):
            v = v << 1 | self.get(128)
        return v

    def signed(self, bits: int) -> int:
        v = self.number(bits)
        return -v if self.get(128) else v

    def optional(self, bits: int) -> int:
        return self.signed(bits) if self.get(128) else 0


# Transforms on (..., 4, 4) arrays


def fdct(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    a, b, c, d = (x[..., 0] + x[..., 3]) * 8, (x[..., 1] + x[..., 2]) * 8, (x[..., 1] - x[..., 2]) * 8, (x[..., 0] - x[..., 3]) * 8
    t = np.stack([a + b, c * 2217 + d * 5352 + 14500 >> 12, a - b, d * 2217 - c * 5352 + 7500 >> 12], -1)
    a, b, c, d = t[..., 0, :] + t[..., 3, :], t[..., 1, :] + t[..., 2, :], t[..., 1, :] - t[..., 2, :], t[..., 0, :] - t[..., 3, :]
    return np.stack([a + b + 7 >> 4, (c * 2217 + d * 5352 + 12000 >> 16) + (d != 0), a - b + 7 >> 4, d * 2217 - c * 5352 + 51000 >> 16], -2)


def idct(x: np.ndarray) -> np.ndarray:
    def half(m, bias, shift):
        dc = m[..., 0, :] + bias
        a, b = dc + m[..., 2, :], dc - m[..., 2, :]
        p, q = m[..., 1, :], m[..., 3, :]
        c, d = (p * 35468 >> 16) - (q * 85627 >> 16), (p * 85627 >> 16) + (q * 35468 >> 16)
        return np.stack([a + d >> shift, b + c >> shift, b - c >> shift, a - d >> shift], -1)

    return half(half(x.astype(np.int64), 0, 0), 4, 3)


def _hadamard(m: np.ndarray, axis: int, bias: int = 0) -> np.ndarray:
    p, q, s, t = (np.take(m, k, axis) for k in range(4))
    p = p + bias
    return np.stack([p + t + q + s, p - t + q - s, p + t - q - s, p - t - q + s], axis)


def fwht(x: np.ndarray) -> np.ndarray:
    return _hadamard(_hadamard(x.astype(np.int64), -1), -2) >> 1


def iwht(x: np.ndarray) -> np.ndarray:
    return _hadamard(_hadamard(x.astype(np.int64), -2), -1, 3) >> 3


def quantized(x: np.ndarray, dc: int, ac: int) -> np.ndarray:
    step = np.full((4, 4), ac)
    step[0, 0] = dc
    return np.sign(x) * ((np.abs(x) + step // 2) // step)


def scaled(x: np.ndarray, dc: int, ac: int) -> np.ndarray:
    out = x * ac
    out[..., 0, 0] = x[..., 0, 0] * dc
    return out


def _at(table: tuple[int, ...], k: int) -> int:
    return table[max(0, min(127, k))]


def steps(index: int, deltas: tuple[int, ...] = (0, 0, 0, 0, 0)) -> dict[str, tuple[int, int]]:
    """(dc, ac) for luma, second-order luma and chroma. deltas: y dc, y2 dc, y2 ac, uv dc, uv ac."""
    q = max(0, min(127, index))
    return {
        "y": (_at(DC_STEPS, q + deltas[0]), AC_STEPS[q]), "y2": (_at(DC_STEPS, q + deltas[1]) * 2, max(8, _at(AC_STEPS, q + deltas[2]) * 155 // 100)),
        "uv": (DC_STEPS[min(117, max(0, min(127, q + deltas[3])))], _at(AC_STEPS, q + deltas[4])),
    }


def index_of_quality(quality: float) -> int:
    q = np.float32(min(100.0, max(0.0, quality)))
    return int(min(127, max(0, np.float32(100 - q) * np.float32(127) / np.float32(100))))


# Prediction


def square(mode: int, n: int, above: np.ndarray, left: np.ndarray, corner: int, have_above: bool, have_left: bool) -> np.ndarray:
    """n x n prediction from borders."""
    if mode == V:
        return np.tile(above[:n], (n, 1))
    if mode == H:
        return np.tile(left[:, None], (1, n))
    if mode == TM:
        return np.clip(left[:, None] + above[None, :n] - corner, 0, 255)
    parts = ([above[:n]] if have_above else []) + ([left] if have_left else [])
    total, size = sum(int(p.sum()) for p in parts), n * len(parts)
    return np.full((n, n), (total + size // 2) // size if size else 128)


def small(mode: int, above: np.ndarray, left: np.ndarray, corner: int) -> np.ndarray:
    """4x4 prediction; above has 8 pixels."""
    name = MODES4[mode]
    if name == "DC":
        return np.full((4, 4), (int(above[:4].sum()) + int(left.sum()) + 4) >> 3)
    if name == "TM":
        return square(TM, 4, above, left, corner, True, True)
    names = dict(zip("pqrs", left.tolist())) | (dict(zip("abcdefgh", above.tolist())) if name in ("LD", "VL") else {"a": int(corner)} | dict(zip("bcdefghi", above.tolist())))
    taps = (t for row in DIRECTIONS[name] for t in row.split())
    one = lambda t: names[t] if len(t) == 1 else names[t[0]] + names[t[1]] + 1 >> 1 if len(t) == 2 else names[t[0]] + 2 * names[t[1]] + names[t[2]] + 2 >> 2
    return np.array([one(t) for t in taps]).reshape(4, 4)


class Plane:
    """Samples of whole macroblocks with the format's borders around them: 127 above, 129 to the left."""

    def __init__(self, h: int, w: int):
        self.s = np.full((h + 1, w + 1), 127, np.int64)
        self.s[1:, 0] = 129
        self.inner = self.s[1:, 1:]

    def borders(self, y: int, x: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """above (n), left (n) and corner of the block at (y, x)."""
        corner = int(self.s[y, x]) if y == 0 or x > 0 else 129
        return self.s[y, x + 1 : x + 1 + n], self.s[y + 1 : y + 1 + n, x], corner


# Tokens


def put_tokens(w: BoolWriter, scan: list[int], probs: np.ndarray, ctx: int, first: int) -> int:
    """Writes the coefficients of one block in scan order; 1 if any is not zero."""
    last = max((k for k in range(first, 16) if scan[k]), default=-1)
    k = first
    p = probs[BANDS[k]][ctx]
    if last < 0:
        w.put(0, p[0])
        return 0
    w.put(1, p[0])
    while True:
        v = abs(scan[k])
        if not v:
            w.put(0, p[1])
            k += 1
            p = probs[BANDS[k]][0]
            continue
        w.put(1, p[1])
        if v == 1:
            w.put(0, p[2])
        else:
            w.put(1, p[2])
            if v <= 4:
                w.put(0, p[3])
                w.put(int(v > 2), p[4])
                if v > 2:
                    w.put(v - 3, p[5])
            else:
                w.put(1, p[3])
                c = max(i for i in range(6) if v >= EXTRA_BASE[i])
                w.put(int(c > 1), p[6])
                if c <= 1:
                    w.put(c, p[7])
                else:
                    w.put(int(c > 3), p[8])
                    w.put((c - 2) & 1, p[9 + (c > 3)])
                bits = EXTRA[c]
                for i, prob in enumerate(bits):
                    w.put((v - EXTRA_BASE[c]) >> (len(bits) - 1 - i) & 1, prob)
        w.put(int(scan[k] < 0), 128)
        k += 1
        if k == 16:
            return 1
        p = probs[BANDS[k]][min(v, 2)]
        if k > last:
            w.put(0, p[0])
            return 1
        w.put(1, p[0])


def get_tokens(r: BoolReader, probs: np.ndarray, ctx: int, first: int) -> tuple[np.ndarray, int]:
    """(4x4 coefficients, 1 if any token was read)."""
    out, k, p = [0] * 16, first, probs[BANDS[first]][ctx]
    if not r.get(p[0]):
        return np.zeros((4, 4), np.int64), 0
    while True:
        while not r.get(p[1]):
            k += 1
            if k == 16:
                return np.array(out).reshape(4, 4), 1
            p = probs[BANDS[k]][0]
        if not r.get(p[2]):
            v = 1
        elif not r.get(p[3]):
            v = 2 if not r.get(p[4]) else 3 + r.get(p[5])
        else:
            if not r.get(p[6]):
                c = r.get(p[7])
            else:
                high = r.get(p[8])
                c = 2 + 2 * high + r.get(p[9 + high])
            v = 0
            for prob in EXTRA[c]:
                v = v << 1 | r.get(prob)
            v += EXTRA_BASE[c]
        out[ZIGZAG[k]] = -v if r.get(128) else v
        k += 1
        if k == 16:
            break
        p = probs[BANDS[k]][min(v, 2)]
        if not r.get(p[0]):
            break
    return np.array(out).reshape(4, 4), 1


# Encoder


def planes_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, Cb, Cr of (h, w, 3), padded to whole macroblocks by repeating edges; chroma takes the top left sample of each 2x2."""
    h, w = rgb.shape[:2]
    rgb = np.pad(rgb, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.int64)
    r, g, b = (rgb[..., k] for k in range(3))
    y = 19595 * r + 38470 * g + 7471 * b + 32768 >> 16
    cb = np.clip(-11056 * r - 21712 * g + 32768 * b + (257 << 15) >> 16, 0, 255)
    cr = np.clip(32768 * r - 27440 * g - 5328 * b + (257 << 15) >> 16, 0, 255)
    return y, cb[::2, ::2], cr[::2, ::2]


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    h, w = y.shape
    u, v = (np.repeat(np.repeat(c, 2, 0), 2, 1)[:h, :w] - 128 for c in (cb, cr))
    yy = y * 0x10101
    return np.clip(np.stack([yy + 91881 * v, yy - 22554 * u - 46802 * v, yy + 116130 * u], -1) >> 16, 0, 255).astype(np.uint8)


def _best(src: np.ndarray, n: int, borders: tuple, have_above: bool, have_left: bool) -> tuple[int, np.ndarray]:
    legal = [DC] + [V] * have_above + [H] * have_left + [TM] * (have_above and have_left)
    guesses = {m: square(m, n, *borders, have_above, have_left) for m in legal}
    mode = min(legal, key=lambda m: int(np.abs(src - guesses[m]).sum()))
    return mode, guesses[mode]


def _fours(block: np.ndarray) -> np.ndarray:
    """The 4x4 blocks of a square block, row by row."""
    n = len(block) // 4
    return block.reshape(n, 4, n, 4).swapaxes(1, 2).reshape(-1, 4, 4)


def _whole(fours: np.ndarray) -> np.ndarray:
    n = int(len(fours) ** 0.5)
    return fours.reshape(n, n, 4, 4).swapaxes(1, 2).reshape(4 * n, 4 * n)


_SCAN = np.array(ZIGZAG)


def encode_rgb(rgb: np.ndarray, quality: float, tables: Tables | None = None) -> bytes:
    """A key frame of pixels (h, w, 3)."""
    t = tables or Tables()
    h, w = rgb.shape[:2]
    if not (0 < w <= MOST_SIDE and 0 < h <= MOST_SIDE):
        raise BadFile(f"a lossy picture has sides of 1 to {MOST_SIDE}")
    src = planes_of(rgb)
    rows, cols = src[0].shape[0] // 16, src[0].shape[1] // 16
    own = [Plane(*s.shape) for s in src]
    index = index_of_quality(quality)
    q = steps(index)
    head, body = BoolWriter(), BoolWriter()
    for value, bits in ((0, 1), (0, 1), (0, 1), (0, 1), (0, 6), (0, 3), (0, 1), (0, 2), (index, 7), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1)):
        head.number(value, bits)
    for p in t.updates.ravel().tolist():
        head.put(0, p)
    head.number(0, 1)
    probs = t.coefficients.tolist()
    above = [[0] * (4 * cols), [0] * (2 * cols), [0] * (2 * cols), [0] * cols]
    for my in range(rows):
        left = [[0] * 4, [0] * 2, [0] * 2, [0]]
        for mx in range(cols):
            va, vl = my > 0, mx > 0
            y, x = 16 * my, 16 * mx
            mode, guess = _best(src[0][y : y + 16, x : x + 16], 16, own[0].borders(y, x, 16), va, vl)
            head.put(1, Y_MODE[0])
            head.put(mode >> 1, Y_MODE[1])
            head.put(mode & 1, Y_MODE[2 + (mode >> 1)])
            c = fdct(_fours(src[0][y : y + 16, x : x + 16] - guess))
            second = quantized(fwht(c[:, 0, 0].reshape(4, 4)), *q["y2"])
            c = quantized(c, *q["y"])
            c[:, 0, 0] = 0
            nz = put_tokens(body, second.ravel()[_SCAN].tolist(), probs[1], above[3][mx] + left[3][0], 0)
            above[3][mx] = left[3][0] = nz
            for k in range(16):
                j, i = k // 4, 4 * mx + k % 4
                above[0][i] = left[0][j] = put_tokens(body, c[k].ravel()[_SCAN].tolist(), probs[0], above[0][i] + left[0][j], 1)
            c = scaled(c, *q["y"])
            c[:, 0, 0] = iwht(scaled(second, *q["y2"])).ravel()
            own[0].inner[y : y + 16, x : x + 16] = np.clip(guess + _whole(idct(c)), 0, 255)
            y, x = 8 * my, 8 * mx
            mode, _ = _best(src[1][y : y + 8, x : x + 8], 8, own[1].borders(y, x, 8), va, vl)
            head.put(int(mode != DC), UV_MODE[0])
            if mode != DC:
                head.put(int(mode != V), UV_MODE[1])
                if mode != V:
                    head.put(int(mode == TM), UV_MODE[2])
            for n in (1, 2):
                guess = square(mode, 8, *own[n].borders(y, x, 8), va, vl)
                c = quantized(fdct(_fours(src[n][y : y + 8, x : x + 8] - guess)), *q["uv"])
                for k in range(4):
                    j, i = k // 2, 2 * mx + k % 2
                    above[n][i] = left[n][j] = put_tokens(body, c[k].ravel()[_SCAN].tolist(), probs[2], above[n][i] + left[n][j], 0)
                own[n].inner[y : y + 8, x : x + 8] = np.clip(guess + _whole(idct(scaled(c, *q["uv"]))), 0, 255)
    one = head.bytes()
    if len(one) >= 1 << 19:
        raise BadFile("the first partition is too large")
    return (len(one) << 5 | 1 << 4).to_bytes(3, "little") + b"\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + one + body.bytes()


# Decoder


def frame_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, size of the first partition) of a key frame."""
    if len(data) < 10:
        raise BadFile("short lossy stream")
    tag = int.from_bytes(data[:3], "little")
    if tag & 1:
        raise BadFile("not a key frame")
    if data[3:6] != b"\x9d\x01\x2a":
        raise BadFile("no start code")
    return int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF, tag >> 5


@dataclass
class Header:
    segments: bool = False
    update_map: bool = False
    absolute: bool = False
    quant: list[int] = field(default_factory=lambda: [0] * 4)
    level: list[int] = field(default_factory=lambda: [0] * 4)
    map_probs: list[int] = field(default_factory=lambda: [255] * 3)
    has_data: bool = False
    simple: bool = False
    filter_level: int = 0
    sharpness: int = 0
    deltas: bool = False
    ref_delta: list[int] = field(default_factory=lambda: [0] * 4)
    mode_delta: list[int] = field(default_factory=lambda: [0] * 4)
    partitions: int = 1
    index: int = 0
    index_deltas: tuple[int, ...] = (0,) * 5
    skip: int | None = None


def compressed_header(r: BoolReader, probs: np.ndarray, updates: np.ndarray) -> Header:
    """Reads the header and puts updates into probs."""
    h = Header()
    r.number(2)
    h.segments = bool(r.get(128))
    if h.segments:
        h.update_map, h.has_data = bool(r.get(128)), bool(r.get(128))
        if h.has_data:
            h.absolute = bool(r.get(128))
            h.quant = [r.optional(7) for _ in range(4)]
            h.level = [r.optional(6) for _ in range(4)]
        if h.update_map:
            h.map_probs = [r.number(8) if r.get(128) else 255 for _ in range(3)]
    h.simple, h.filter_level, h.sharpness, h.deltas = bool(r.get(128)), r.number(6), r.number(3), bool(r.get(128))
    if h.deltas and r.get(128):
        h.ref_delta = [r.optional(6) for _ in range(4)]
        h.mode_delta = [r.optional(6) for _ in range(4)]
    h.partitions = 1 << r.number(2)
    h.index = r.number(7)
    h.index_deltas = tuple(r.optional(4) for _ in range(5))
    r.get(128)
    flat = probs.reshape(-1)
    for k, p in enumerate(updates.ravel().tolist()):
        if r.get(p):
            flat[k] = r.number(8)
    h.skip = r.number(8) if r.get(128) else None
    return h


def _split(data: bytes, at: int, n: int) -> list[bytes]:
    """Partitions, whose sizes but the last's stand in front of them."""
    start, out = at + 3 * (n - 1), []
    for k in range(n):
        size = int.from_bytes(data[at + 3 * k : at + 3 * k + 3], "little") if k < n - 1 else len(data) - start
        if start + size > len(data):
            raise BadFile("cut partition")
        out.append(data[start : start + size])
        start += size
    return out


def _filter_limits(h: Header, segment: int, four: bool) -> tuple[int, int, int]:
    level = h.filter_level
    if h.segments and h.has_data:
        level = h.level[segment] if h.absolute else level + h.level[segment]
    if h.deltas:
        level += h.ref_delta[0] + (h.mode_delta[0] if four else 0)
    if level <= 0:
        return 0, 0, 0
    level = min(63, level)
    inner = level >> (2 if h.sharpness > 4 else 1) if h.sharpness else level
    inner = max(1, min(inner, 9 - h.sharpness) if h.sharpness else inner)
    return 2 * level + inner, inner, 0 if level < 15 else 1 if level < 40 else 2


def _filter(s: np.ndarray, level: int, inner: int, high: int, edge: bool, simple: bool) -> None:
    """Filters the edge between s[3] and s[4] of (8, n) samples in place (a view); edge: of a macroblock."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (s[k].copy() for k in range(8))
    clip = lambda v, b: np.clip(v, -b, b - 1)
    on = np.abs(p0 - q0) * 2 + (np.abs(p1 - q1) >> 1) <= level
    a = 3 * (q0 - p0) + clip(p1 - q1, 128)
    two = clip(a + 3 >> 3, 16), clip(a + 4 >> 3, 16)
    put = lambda k, v, where: s[k].__setitem__(where, np.clip(v, 0, 255)[where])
    if simple:
        put(3, p0 + two[0], on)
        put(4, q0 - two[1], on)
        return
    for x, y in ((p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2)):
        on = on & (np.abs(x - y) <= inner)
    hev = (np.abs(p1 - p0) > high) | (np.abs(q1 - q0) > high)
    sharp, soft = on & hev, on & ~hev
    put(3, p0 + two[0], sharp)
    put(4, q0 - two[1], sharp)
    if edge:
        w = clip(a, 128)
        for k, (m, p, q) in enumerate(((27, p0, q0), (18, p1, q1), (9, p2, q2))):
            d = m * w + 63 >> 7
            put(3 - k, p + d, soft)
            put(4 + k, q - d, soft)
    else:
        b = 3 * (q0 - p0)
        far, near = clip(b + 4 >> 3, 16), clip(b + 3 >> 3, 16)
        out = far + 1 >> 1
        for k, v in ((2, p1 + out), (3, p0 + near), (4, q0 - far), (5, q1 - out)):
            put(k, v, soft)


def _loop_filter(own: list[Plane], h: Header, info: list[list[tuple[int, bool, bool]]]) -> None:
    """Edges of every macroblock in raster order: left, inner vertical, top, inner horizontal."""
    for my, row in enumerate(info):
        for mx, (segment, four, inside) in enumerate(row):
            level, inner, high = _filter_limits(h, segment, four)
            if not level:
                continue
            for s, n in [(own[0].inner, 16)] + ([] if h.simple else [(own[1].inner, 8), (own[2].inner, 8)]):
                y, x = n * my, n * mx
                for upright in (True, False):
                    view = s.T if upright else s
                    a, b = (x, y) if upright else (y, x)
                    for k in range(0, n if inside else 1, 4):
                        if k or a:
                            _filter(view[a + k - 4 : a + k + 4, b : b + n], level + (0 if k else 4), inner, high, not k, h.simple)


def decode_planes(data: bytes, tables: Tables | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y (h, w) and Cb, Cr of half the size, rounded up."""
    t = tables or Tables()
    w, h, size = frame_header(data)
    if not w or not h:
        raise BadFile("empty frame")
    if 10 + size >= len(data) + 1:
        raise BadFile("cut first partition")
    probs = t.coefficients.copy()
    head = BoolReader(data[10 : 10 + size])
    hd = compressed_header(head, probs, t.updates)
    bodies = [BoolReader(p) for p in _split(data, 10 + size, hd.partitions)]
    probs = probs.tolist()
    modes_probs = t.modes.tolist()
    rows, cols = (h + 15) // 16, (w + 15) // 16
    own = [Plane(16 * rows, 16 * cols), Plane(8 * rows, 8 * cols), Plane(8 * rows, 8 * cols)]
    above = [[0] * (4 * cols), [0] * (2 * cols), [0] * (2 * cols), [0] * cols]
    up_modes = [0] * (4 * cols)
    info = []
    for my in range(rows):
        left, left_modes, row = [[0] * 4, [0] * 2, [0] * 2, [0]], [0] * 4, []
        body = bodies[my % hd.partitions]
        for mx in range(cols):
            segment = 0
            if hd.update_map:
                segment = 2 + head.get(hd.map_probs[2]) if head.get(hd.map_probs[0]) else head.get(hd.map_probs[1])
            skip = bool(head.get(hd.skip)) if hd.skip is not None else False
            if head.get(Y_MODE[0]):
                high = head.get(Y_MODE[1])
                mode = 2 * high + head.get(Y_MODE[2 + high])
                same = {DC: 0, TM: 1, V: 2, H: 3}[mode]
                up_modes[4 * mx : 4 * mx + 4] = left_modes[:] = [same] * 4
                small_modes = []
            else:
                mode, small_modes = B_PRED, []
                for k in range(16):
                    p, n = modes_probs[up_modes[4 * mx + k % 4]][left_modes[k // 4]], 0
                    while True:
                        n = TREE4[n + head.get(p[n >> 1])]
                        if n <= 0:
                            break
                    up_modes[4 * mx + k % 4] = left_modes[k // 4] = -n
                    small_modes.append(-n)
            uv = DC if not head.get(UV_MODE[0]) else V if not head.get(UV_MODE[1]) else TM if head.get(UV_MODE[2]) else H
            base = hd.index
            if hd.segments and hd.has_data:
                base = hd.quant[segment] if hd.absolute else base + hd.quant[segment]
            q = steps(base, hd.index_deltas)
            coefficients = np.zeros((24, 4, 4), np.int64)
            any_token = 0
            if skip:
                for n, m in ((0, 4), (1, 2), (2, 2)):
                    above[n][m * mx : m * mx + m] = left[n][:] = [0] * m
                if mode != B_PRED:
                    above[3][mx] = left[3][0] = 0
            else:
                plane, first = 3, 0
                if mode != B_PRED:
                    second, nz = get_tokens(body, probs[1], above[3][mx] + left[3][0], 0)
                    above[3][mx] = left[3][0] = nz
                    any_token |= nz
                    plane, first = 0, 1
                for k in range(16):
                    j, i = k // 4, 4 * mx + k % 4
                    c, nz = get_tokens(body, probs[plane], above[0][i] + left[0][j], first)
                    above[0][i] = left[0][j] = nz
                    any_token |= nz
                    coefficients[k] = c
                coefficients[:16] = scaled(coefficients[:16], *q["y"])
                if mode != B_PRED:
                    coefficients[:16, 0, 0] = iwht(scaled(second, *q["y2"])).ravel()
                for n in (1, 2):
                    for k in range(4):
                        j, i = k // 2, 2 * mx + k % 2
                        c, nz = get_tokens(body, probs[2], above[n][i] + left[n][j], 0)
                        above[n][i] = left[n][j] = nz
                        any_token |= nz
                        coefficients[12 + 4 * n + k] = c
                coefficients[16:] = scaled(coefficients[16:], *q["uv"])
            residual = idct(coefficients)
            va, vl = my > 0, mx > 0
            y, x = 16 * my, 16 * mx
            if mode != B_PRED:
                own[0].inner[y : y + 16, x : x + 16] = np.clip(square(mode, 16, *own[0].borders(y, x, 16), va, vl) + _whole(residual[:16]), 0, 255)
            else:
                s = own[0].s
                beyond = s[y, x + 17 : x + 21] if va and mx < cols - 1 else np.full(4, s[y, x + 16] if va else 127)
                for k in range(16):
                    j, i = y + k // 4 * 4, x + k % 4 * 4
                    ab, le, corner = own[0].borders(j, i, 4)
                    if vl is False and i == x and j > y:
                        corner = 129
                    right = beyond if k % 4 == 3 else s[j, i + 5 : i + 9]
                    own[0].inner[j : j + 4, i : i + 4] = np.clip(small(small_modes[k], np.concatenate([ab, right]), le, corner) + residual[k], 0, 255)
            y, x = 8 * my, 8 * mx
            for n in (1, 2):
                own[n].inner[y : y + 8, x : x + 8] = np.clip(square(uv, 8, *own[n].borders(y, x, 8), va, vl) + _whole(residual[12 + 4 * n : 16 + 4 * n]), 0, 255)
            row.append((segment, mode == B_PRED, mode == B_PRED or bool(any_token)))
        info.append(row)
    if hd.filter_level:
        _loop_filter(own, hd, info)
    return own[0].inner[:h, :w], own[1].inner[: (h + 1) // 2, : (w + 1) // 2], own[2].inner[: (h + 1) // 2, : (w + 1) // 2]


def decode_rgb(data: bytes, tables: Tables | None = None) -> np.ndarray:
    return rgb_of(*decode_planes(data, tables))
