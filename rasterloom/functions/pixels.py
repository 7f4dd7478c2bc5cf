"""Pixel arithmetic as Column expressions.

A pixel is a Pixel of four integer Columns (a, r, g, b). Everything stays in built-in expressions, so Spark compiles it into its
generated code. Packed pixels are BIGINT, as 32 unsigned bits do not fit INT.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pixel(NamedTuple):
    a: Column
    r: Column
    g: Column
    b: Column


def pixel(prefix: str = "") -> Pixel:
    return Pixel(*(F.col(prefix + c) for c in "argb"))


def each(f: Callable[..., Column], *pixels: Pixel) -> Pixel:
    """f on each channel."""
    return Pixel(*(f(*cs) for cs in zip(*pixels)))


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("long")


def half(v: Column) -> Column:
    """v / 2 toward zero."""
    return F.when(v >= 0, F.shiftright(v, 1)).otherwise(-F.shiftright(-v, 1))


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def byte(v: Column) -> Column:
    """v modulo 256, also for negative v."""
    return v.bitwiseAND(F.lit(255))


def signed(v: Column) -> Column:
    """A byte as a signed number."""
    return F.when(v > 127, v - 256).otherwise(v)


def pack(p: Pixel) -> Column:
    return F.shiftleft(p.a.cast("long"), 24).bitwiseOR(F.shiftleft(p.r.cast("long"), 16)).bitwiseOR(F.shiftleft(p.g.cast("long"), 8)).bitwiseOR(p.b.cast("long"))


def unpack(argb: Column) -> Pixel:
    return Pixel(*(byte(F.shiftright(argb, s)).cast("int") for s in (24, 16, 8, 0)))


def add(p: Pixel, q: Pixel) -> Pixel:
    return each(lambda x, y: byte(x + y), p, q)


def subtract(p: Pixel, q: Pixel) -> Pixel:
    return each(lambda x, y: byte(x - y), p, q)


def subtract_green(p: Pixel) -> Pixel:
    return Pixel(p.a, byte(p.r - p.g), p.g, byte(p.b - p.g))


def add_green(p: Pixel) -> Pixel:
    return Pixel(p.a, byte(p.r + p.g), p.g, byte(p.b + p.g))


def average(p: Pixel, q: Pixel) -> Pixel:
    return each(lambda x, y: F.shiftright(x + y, 1), p, q)


def distance(p: Pixel, q: Pixel) -> Column:
    """Sum of the channels' absolute differences."""
    d = each(lambda x, y: F.abs(x - y), p, q)
    return d.a + d.r + d.g + d.b


def channel_sum(p: Pixel) -> Column:
    return p.a + p.r + p.g + p.b


def choose(condition: Column, p: Pixel, q: Pixel) -> Pixel:
    return each(lambda x, y: F.when(condition, x).otherwise(y), p, q)


def gradient(left: Column, top: Column, corner: Column) -> Column:
    return clamp(left + top - corner)


def predictions(left: Pixel, top: Pixel, corner: Pixel, right: Pixel) -> list[Pixel]:
    """What the 14 spatial modes predict from the neighbours left, above, above left (corner) and above right (right)."""
    black = Pixel(F.lit(255), F.lit(0), F.lit(0), F.lit(0))
    nearer = choose(distance(corner, left) < distance(corner, top), left, top)
    full = each(gradient, left, top, corner)
    halved = each(lambda x, y: clamp(x + half(x - y)), average(left, top), corner)
    return [
        black, left, top, right, corner, average(average(left, right), top), average(left, corner), average(left, top), average(corner, top), average(top, right),
        average(average(left, corner), average(top, right)), nearer, full, halved,
    ]


def residual_cost(p: Pixel) -> Column:
    """Distance of the channels from zero, modulo 256."""
    c = each(lambda v: F.least(v, 256 - v), p)
    return c.a + c.r + c.g + c.b


def cache_slot(argb: Column, bits: int) -> Column:
    """Slot of a packed pixel in a color cache of 2**bits; 0x1e35a7bd is the format's multiplier (fixed value)."""
    return F.shiftright((argb * 0x1E35A7BD) % (1 << 32), 32 - bits)


def subsampled(size: Column, bits: int) -> Column:
    """Blocks of 2**bits that cover size."""
    return F.shiftright(size + ((1 << bits) - 1), bits)


def blend(dst: Pixel, src: Pixel) -> Pixel:
    """src over dst, not premultiplied, with truncating division."""
    rest = div(dst.a * (255 - src.a), 255)
    alpha = src.a + rest
    mix = lambda d, s: div(s * src.a + d * rest, F.when(alpha == 0, 1).otherwise(alpha))
    mixed = Pixel(alpha, mix(dst.r, src.r), mix(dst.g, src.g), mix(dst.b, src.b))
    zero = Pixel(*[F.lit(0)] * 4)
    return Pixel(*(F.when(src.a == 255, s).when(alpha == 0, z).when(src.a == 0, d).otherwise(m).cast("int") for s, z, d, m in zip(src, zero, dst, mixed)))


def rgb_to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 full range in 16-bit fixed point (weights of the JFIF conversion, fixed values)."""
    y = F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)
    cb = F.shiftright(-11056 * r - 21712 * g + 32768 * b + (257 << 15), 16)
    cr = F.shiftright(32768 * r - 27440 * g - 5328 * b + (257 << 15), 16)
    return y, clamp(cb), clamp(cr)


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    yy, u, v = y * 0x10101, cb - 128, cr - 128
    return tuple(clamp(F.shiftright(c, 16)) for c in (yy + 91881 * v, yy - 22554 * u - 46802 * v, yy + 116130 * u))


def quality_to_qp(quality: Column) -> Column:
    """Quantiser index of a quality, in single precision as the format's tools compute it."""
    q = F.least(F.lit(100.0), F.greatest(F.lit(0.0), quality)).cast("float")
    return clamp(((F.lit(100.0).cast("float") - q) * F.lit(127.0).cast("float") / F.lit(100.0).cast("float")).cast("float").cast("int"), 0, 127)


def quantize_level(v: Column, levels: int) -> Column:
    """Alpha value reduced to `levels` evenly spaced ones (their middles); outside 1..255 levels nothing changes."""
    if not 0 < levels < 256:
        return v
    step = 256.0 / levels
    level = F.least(F.lit(levels - 1), F.floor(v / step))
    return F.floor(level * step + step / 2).cast("int")
