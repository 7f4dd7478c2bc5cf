"""The lossless stream: encoder and decoder for one picture as an array of ARGB numbers.

Transforms are whole-array numpy steps; only entropy decoding, back references and inverse prediction go pixel by pixel. By default
predictor and color transforms follow the reading in which pixel (0, 0) is not predicted, the right edge takes the pixel above for
above right, and `select` takes left when it is nearer to the corner; published=True follows the published format there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..operators.lossless import NEAR, prefix_bases
from . import prefix
from .bits import BitReader, BitWriter
from .riff import BadFile

SIGNATURE, MOST_SIDE = 0x2F, 16384
PREDICT, COLOR, GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = prefix_bases(24), prefix_bases(40)
HASH = 0x1E35A7BD  # the format's multiplier (fixed value)
DEPTH, LONGEST, REACH = 8, 4096, 1 << 18


@dataclass
class Options:
    """None for predictor and color: chosen by size. Block sizes are powers of two, 2 to 9."""

    palette: bool = True
    subtract_green: bool = True
    predictor: bool | None = None
    color: bool | None = None
    references: bool = False
    predictor_bits: int = 4
    color_bits: int = 4
    published: bool = False


def channels(p: np.ndarray) -> np.ndarray:
    """(..., 4) of a, r, g, b."""
    return np.stack([p >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# Prediction


def _trunc_half(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v >> 1, -(-v >> 1))


def _guess(mode: int, left, top, corner, right, published: bool):
    """One mode's prediction from neighbours' channels; works on single pixels and on arrays of them."""
    if mode == 0:
        out = np.zeros_like(left)
        out[..., 0] = 255
        return out
    if mode == 11:
        a, b = np.abs(corner - left).sum(-1), np.abs(corner - top).sum(-1)
        take = (b < a) if published else (a < b)
        return np.where(take[..., None], left, top)
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    half = lambda p, q: (p + q) >> 1
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = half(left, top)
        return np.clip(m + _trunc_half(m - corner), 0, 255)
    return {
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode, lambda: left)()


def _neighbours(img: np.ndarray, published: bool) -> tuple[np.ndarray, ...]:
    """left, top, corner, right of every pixel; what lies outside is of no use."""
    left, top, corner, right = (np.zeros_like(img) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:], right[1:, :-1] = img[:, :-1], img[:-1], img[:-1, :-1], img[:-1, 1:]
    right[1:, -1] = img[1:, 0] if published else img[:-1, -1]
    return left, top, corner, right


def predicted(img: np.ndarray, modes: np.ndarray, bits: int, published: bool) -> np.ndarray:
    """What every pixel of img (h, w, 4) is predicted to be, from original neighbours."""
    near = _neighbours(img, published)
    h, w = img.shape[:2]
    each = modes[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    out = np.zeros_like(img)
    for m in np.unique(each):
        own = each == m
        out[own] = _guess(int(m), *(n[own] for n in near), published)
    out[0, 1:], out[1:, 0] = img[0, :-1], img[:-1, 0]
    out[0, 0] = [255, 0, 0, 0] if published else 0
    return out


def choose_modes(img: np.ndarray, bits: int, published: bool) -> np.ndarray:
    """For every block the first mode of least residual cost."""
    h, w = img.shape[:2]
    by, bx = blocks(h, bits), blocks(w, bits)
    costs = []
    for m in range(14):
        r = (img - predicted(img, np.full((by, bx), m), bits, published)) & 255
        r[0, 0] = 0
        c = np.minimum(r, 256 - r).sum(-1)
        full = np.zeros((by << bits, bx << bits), np.int64)
        full[:h, :w] = c
        costs.append(full.reshape(by, 1 << bits, bx, 1 << bits).sum((1, 3)))
    return np.argmin(costs, 0)


def unpredict(res: np.ndarray, modes: np.ndarray, bits: int, published: bool) -> np.ndarray:
    """Adds predictions back; each pixel needs those before it, so this goes pixel by pixel except for the borders."""
    h, w = res.shape[:2]
    out = res.copy()
    if published:
        out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    out[:, 0] = np.cumsum(out[:, 0], 0) & 255
    for y in range(1, h):
        row = modes[y >> bits]
        x = 1
        while x < w:
            m, end = int(row[x >> bits]), min(w, ((x >> bits) + 1) << bits)
            up = out[y - 1]
            if m in (0, 2, 3, 4, 8, 9):  # from the row above alone: the rest of the block at once
                right = np.concatenate([up[x + 1 : end + 1], out[y : y + 1, 0] if published else up[-1:]])[: end - x]
                out[y, x:end] = (out[y, x:end] + _guess(m, up[x:end], up[x:end], up[x - 1 : end - 1], right, published)) & 255
                x = end
                continue
            if m == 1:
                out[y, x:end] = np.cumsum(np.concatenate([out[y, x - 1 : x], out[y, x:end]]), 0)[1:] & 255
                x = end
                continue
            right = up[x + 1] if x + 1 < w else (out[y, 0] if published else up[x])
            out[y, x] = (out[y, x] + _guess(m, out[y, x - 1], up[x], up[x - 1], right, published)) & 255
            x += 1
    return out


# Color


def _signed(v):
    return ((v & 255) ^ 128) - 128


def _div(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def color_coefficients(img: np.ndarray, bits: int) -> np.ndarray:
    """(by, bx, 3): green to red, green to blue, red to blue, by least squares."""
    h, w = img.shape[:2]
    out = np.zeros((blocks(h, bits), blocks(w, bits), 3), np.int64)
    clip = lambda v: max(-128, min(127, v))
    for j in range(out.shape[0]):
        for i in range(out.shape[1]):
            part = img[j << bits : (j + 1) << bits, i << bits : (i + 1) << bits].reshape(-1, 4)
            r, g, b = part[:, 1], part[:, 2], part[:, 3]
            gg = int((g * g).sum())
            gr, gb = (clip(_div(32 * int((g * c).sum()), gg)) if gg else 0 for c in (r, b))
            shift = gr * g >> 5
            red = ((r - shift) & 255) + shift
            rr = int((red * red).sum())
            out[j, i] = gr, gb, clip(_div(32 * int((red * (b - (gb * g >> 5))).sum()), rr)) if rr else 0
    return out


def color_transform(img: np.ndarray, own: np.ndarray, bits: int, inverse: bool, published: bool) -> np.ndarray:
    h, w = img.shape[:2]
    gr, gb, rb = (own[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits, k] for k in range(3))
    out = img.copy()
    g = _signed(img[..., 2]) if published else img[..., 2]
    shift = gr * g >> 5
    stored = img[..., 1] if inverse else (img[..., 1] - shift) & 255
    red = stored + shift
    if published:
        red = _signed(red)
    blue = (gb * g >> 5) + (rb * red >> 5)
    out[..., 1] = red & 255 if inverse else stored
    out[..., 3] = (img[..., 3] + blue if inverse else img[..., 3] - blue) & 255
    return out


# Palette


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def nearest_order(colors: np.ndarray) -> np.ndarray:
    """Colors from the darkest on, each the nearest to the one before (ties: as they stood)."""
    rest = channels(colors)
    order = list(range(len(colors)))
    start = int(np.argmin(rest.sum(1)))
    order[0], order[start] = order[start], order[0]
    for k in range(1, len(order)):
        d = np.abs(rest[order[k:]] - rest[order[k - 1]]).sum(1)
        best = k + int(np.argmin(d))
        order[k], order[best] = order[best], order[k]
    return colors[order]


# Entropy-coded images


def _references(p: list[int], width: int) -> list[tuple[int, int, int]]:
    """Tokens (pixel, 0, 0) or (-1, length, distance code): the longest of the last DEPTH places with the same pixel, nearest first."""
    plane = {}
    for code in range(120, 0, -1):
        plane[max(1, (NEAR[code - 1] >> 4) * width + 8 - (NEAR[code - 1] & 15))] = code
    heads: dict[int, list[int]] = {}
    out, at, size = [], 0, len(p)
    while at < size:
        best = far = 0
        for q in reversed(heads.get(p[at], ())[-DEPTH:]):
            if at - q > REACH:
                break
            n, most = 1, min(LONGEST, size - at)
            while n < most and p[q + n] == p[at + n]:
                n += 1
            if n > best:
                best, far = n, at - q
        heads.setdefault(p[at], []).append(at)
        if best >= 2:
            out.append((-1, best, plane.get(far, far + 120)))
            at += best
        else:
            out.append((p[at], 0, 0))
            at += 1
    return out


def _code_of(values: np.ndarray, bases: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    firsts, extra = (np.array(c) for c in zip(*bases))
    k = np.searchsorted(firsts, values, side="right") - 1
    return k, values - firsts[k], extra[k]


def write_image(w: BitWriter, pixels: np.ndarray, width: int, references: bool, top: bool) -> None:
    """No color cache, one group of codes."""
    w.write(0, 1)
    if top:
        w.write(0, 1)
    flat = pixels.ravel().astype(np.int64)
    if references:
        tokens = np.array(_references(flat.tolist(), width), np.int64).reshape(-1, 3)
    else:
        tokens = np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)], 1)
    literal = tokens[:, 1] == 0
    lit, ref = tokens[literal, 0], tokens[~literal]
    lk, lx, ln = _code_of(ref[:, 1], LENGTHS)
    dk, dx, dn = _code_of(ref[:, 2], DISTANCES)
    green = np.empty(len(tokens), np.int64)
    green[literal], green[~literal] = lit >> 8 & 255, 256 + lk
    symbols = [(green, 280), (lit >> 16 & 255, 256), (lit & 255, 256), (lit >> 24 & 255, 256), (dk, 40)]
    coded = []
    for s, n in symbols:
        lengths = prefix.limited_lengths(np.bincount(s, minlength=n))
        if n == 40 and not len(s):
            lengths[0] = 1
        prefix.write_lengths(w, lengths)
        alone = np.count_nonzero(lengths) <= 1
        coded.append((prefix.canonical(lengths), np.zeros_like(lengths) if alone else lengths))
    values, sizes = np.zeros((len(tokens), 4), np.int64), np.zeros((len(tokens), 4), np.int64)
    values[:, 0], sizes[:, 0] = coded[0][0][green], coded[0][1][green]
    for k, (s, (code, size)) in enumerate(zip((lit >> 16 & 255, lit & 255, lit >> 24 & 255), coded[1:4]), 1):
        values[literal, k], sizes[literal, k] = code[s], size[s]
    for k, (v, n) in enumerate(((lx, ln), (coded[4][0][dk], coded[4][1][dk]), (dx, dn)), 1):
        values[~literal, k], sizes[~literal, k] = v, n
    w.extend(values, sizes)


def read_image(r: BitReader, width: int, height: int, top: bool, published: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise BadFile("color cache too large")
    groups, bits = None, 0
    if top and r.read(1):
        bits = r.read(3) + 2
        groups = read_image(r, blocks(width, bits), blocks(height, bits), False, published) >> 8 & 0xFFFF
    n = int(groups.max()) + 1 if groups is not None else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[prefix.Decoder(prefix.read_lengths(r, s, published)) for s in sizes] for _ in range(n)]
    total, out, cache, inserted = width * height, [], [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    own = codes[0]
    while len(out) < total:
        at = len(out)
        if groups is not None:
            own = codes[int(groups[(at // width) >> bits, (at % width) >> bits])]
        s = own[0].read(r)
        if s < 256:
            red, blue, alpha = own[1].read(r), own[2].read(r), own[3].read(r)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            base, extra = LENGTHS[s - 256]
            length = base + r.read(extra)
            base, extra = DISTANCES[own[4].read(r)]
            code = base + r.read(extra)
            far = code - 120 if code > 120 else max(1, (NEAR[code - 1] >> 4) * width + 8 - (NEAR[code - 1] & 15))
            if far > at:
                raise BadFile("reference before the picture")
            for k in range(at - far, at - far + min(length, total - at)):
                out.append(out[k])
        else:
            if not cache_bits:
                raise BadFile("cache symbol without a cache")
            for p in out[inserted:]:
                cache[(p * HASH & 0xFFFFFFFF) >> shift] = p
            inserted = len(out)
            out.append(cache[s - 280])
    return np.array(out, np.int64).reshape(height, width)


# Whole streams


def _checked(width: int, height: int) -> None:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise BadFile(f"a lossless picture has sides of 1 to {MOST_SIDE}, not {width} x {height}")


def encode_pixels(pixels: np.ndarray, options: Options | None = None, header: bool = True) -> bytes:
    """A stream of pixels (h, w) as ARGB numbers."""
    o = options or Options()
    h, w = pixels.shape
    _checked(w, h)
    out = BitWriter()
    pixels = pixels.astype(np.int64)
    if header:
        out.write(SIGNATURE, 8)
        out.write(w - 1, 14)
        out.write(h - 1, 14)
        out.write(int((pixels >> 24 != 255).any()), 1)
        out.write(0, 3)
    colors, first = np.unique(pixels, return_index=True)
    large = w * h > 1024
    if o.palette and len(colors) <= 256:
        own = nearest_order(colors[np.argsort(first, kind="stable")])
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(own) - 1, 8)
        deltas = joined(np.diff(channels(own), axis=0, prepend=0))
        write_image(out, deltas[None], len(own), True, False)
        index = np.empty(len(colors), np.int64)
        index[np.searchsorted(colors, own)] = np.arange(len(own))
        pixels = index[np.searchsorted(colors, pixels)]
        if xbits := palette_bits(len(own)):
            many = 1 << xbits
            padded = np.pad(pixels, ((0, 0), (0, -w % many))).reshape(h, -1, many)
            pixels = (padded << np.arange(many) * (8 >> xbits)).sum(2)
        pixels = pixels << 8
    else:
        img = channels(pixels)
        if o.predictor or o.predictor is None and large:
            bits = min(9, max(2, o.predictor_bits))
            modes = choose_modes(img, bits, o.published)
            out.write(1, 1)
            out.write(PREDICT, 2)
            out.write(bits - 2, 3)
            write_image(out, modes << 8, modes.shape[1], True, False)
            img = (img - predicted(img, modes, bits, o.published)) & 255
        if o.color or o.color is None and large:
            bits = min(9, max(2, o.color_bits))
            c = color_coefficients(img, bits)
            packed = np.stack([np.full(c.shape[:2], 255), c[..., 2], c[..., 1], c[..., 0]] if o.published else [np.full(c.shape[:2], 255), c[..., 0], c[..., 2], c[..., 1]], -1)
            out.write(1, 1)
            out.write(COLOR, 2)
            out.write(bits - 2, 3)
            write_image(out, joined(packed), c.shape[1], True, False)
            img = color_transform(img, c, bits, False, o.published)
        if o.subtract_green:
            out.write(1, 1)
            out.write(GREEN, 2)
            img[..., 1] = (img[..., 1] - img[..., 2]) & 255
            img[..., 3] = (img[..., 3] - img[..., 2]) & 255
        pixels = joined(img)
    out.write(0, 1)
    write_image(out, pixels, pixels.shape[1], o.references, True)
    return out.bytes()


def config(data: bytes) -> tuple[int, int, bool]:
    if len(data) < 5 or data[0] != SIGNATURE:
        raise BadFile("not a lossless stream")
    bits = int.from_bytes(data[1:5], "little")
    if bits >> 29:
        raise BadFile("unknown version of the lossless stream")
    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)


def decode_pixels(data: bytes, size: tuple[int, int] | None = None, published: bool = False) -> np.ndarray:
    """Pixels (h, w) as ARGB numbers. size: (width, height) of a stream without a header."""
    r = BitReader(data)
    if size is None:
        w, h, _ = config(data)
        r.skip(40)
    else:
        w, h = size
    _checked(w, h)
    try:
        return _decoded(r, w, h, published)
    except (EOFError, ValueError, IndexError) as e:
        raise e if isinstance(e, BadFile) else BadFile(f"lossless stream: {e}") from e


def _decoded(r: BitReader, w: int, h: int, published: bool) -> np.ndarray:
    steps, width = [], w
    while r.read(1):
        kind = r.read(2)
        if kind in [s[0] for s in steps]:
            raise BadFile("a transform given twice")
        if kind in (PREDICT, COLOR):
            bits = r.read(3) + 2
            steps.append((kind, bits, read_image(r, blocks(width, bits), blocks(h, bits), False, published), width))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colors = joined(np.cumsum(channels(read_image(r, n, 1, False, published)[0]), 0))
            steps.append((kind, palette_bits(n), colors, width))
            width = blocks(width, palette_bits(n))
        else:
            steps.append((kind, 0, None, width))
    img = channels(read_image(r, width, h, True, published))
    for kind, bits, data, width in reversed(steps):
        if kind == GREEN:
            img[..., 1] = (img[..., 1] + img[..., 2]) & 255
            img[..., 3] = (img[..., 3] + img[..., 2]) & 255
        elif kind == PREDICT:
            img = unpredict(img, data >> 8 & 255, bits, published)
        elif kind == COLOR:
            c = channels(data)
            own = np.stack([_signed(c[..., k]) for k in ((3, 2, 1) if published else (1, 3, 2))], -1)
            img = color_transform(img, own, bits, True, published)
        else:
            index = img[..., 2]
            if bits:
                index = (index[..., None] >> np.arange(1 << bits) * (8 >> bits) & (1 << (8 >> bits)) - 1).reshape(h, -1)[:, :width]
            img = channels(np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0))
    return joined(img)


def encode_rgba(rgba: np.ndarray, options: Options | None = None) -> bytes:
    """Of pixels (h, w, 4) as r, g, b, a; what cannot be seen is stored as zero."""
    c = rgba.astype(np.int64)
    return encode_pixels(np.where(c[..., 3] == 0, 0, joined(c[..., [3, 0, 1, 2]])), options)


def decode_rgba(data: bytes, published: bool = False) -> np.ndarray:
    return channels(decode_pixels(data, published=published))[..., [1, 2, 3, 0]].astype(np.uint8)
