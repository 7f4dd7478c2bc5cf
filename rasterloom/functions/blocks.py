"""4x4 and larger block arithmetic as Column expressions. A block is a list of Columns in row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import clamp, div

Block = list[Column]

#: Order in which coefficients are coded, and the context band of each place (fixed values).
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)

#: Quantiser steps by index (fixed values).
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17,
    18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28,
    29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43,
    44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74,
    75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118,
    122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19,
    20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35,
    36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51,
    52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108,
    110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152,
    155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209,
    213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)


def columns(prefix: str, n: int = 16) -> Block:
    return [F.col(f"{prefix}{k}") for k in range(n)]


def _s(v: Column, n: int) -> Column:
    return F.shiftright(v, n)


def fdct_rows(x: Block) -> Block:
    """First half of the forward transform, along rows; results feed fdct_columns."""
    out: Block = []
    for r in range(4):
        p, q, s, t = x[4 * r : 4 * r + 4]
        a, b, c, d = (p + t) * 8, (q + s) * 8, (q - s) * 8, (p - t) * 8
        out += [a + b, _s(c * 2217 + d * 5352 + 14500, 12), a - b, _s(d * 2217 - c * 5352 + 7500, 12)]
    return out


def fdct_columns(x: Block) -> Block:
    out: Block = [F.lit(0)] * 16
    for k in range(4):
        p, q, s, t = x[k], x[4 + k], x[8 + k], x[12 + k]
        a, b, c, d = p + t, q + s, q - s, p - t
        out[k], out[8 + k] = _s(a + b + 7, 4), _s(a - b + 7, 4)
        out[4 + k] = _s(c * 2217 + d * 5352 + 12000, 16) + F.when(d != 0, 1).otherwise(0)
        out[12 + k] = _s(d * 2217 - c * 5352 + 51000, 16)
    return out


def _rotate(p: Column, q: Column) -> tuple[Column, Column]:
    """The odd half of the inverse transform: p, q are the odd coefficients."""
    return _s(p * 35468, 16) - _s(q * 85627, 16), _s(p * 85627, 16) + _s(q * 35468, 16)


def idct_columns(x: Block) -> Block:
    """First half of the inverse transform; the result is transposed, as idct_rows takes it."""
    out: Block = []
    for k in range(4):
        a, b = x[k] + x[8 + k], x[k] - x[8 + k]
        c, d = _rotate(x[4 + k], x[12 + k])
        out += [a + d, b + c, b - c, a - d]
    return out


def idct_rows(m: Block) -> Block:
    """Second half: residuals in row order, to be added to a prediction."""
    out: Block = []
    for j in range(4):
        a, b = m[j] + 4 + m[8 + j], m[j] + 4 - m[8 + j]
        c, d = _rotate(m[4 + j], m[12 + j])
        out += [_s(a + d, 3), _s(b + c, 3), _s(b - c, 3), _s(a - d, 3)]
    return out


def idct_dc(dc: Column) -> Column:
    return _s(dc + 4, 3)


def _hadamard(p: Column, q: Column, s: Column, t: Column) -> Block:
    a, b, c, d = p + t, q + s, q - s, p - t
    return [a + b, d + c, a - b, d - c]


def fwht(x: Block, stage: int) -> Block:
    """Forward Walsh-Hadamard: stage 0 along rows, stage 1 along columns."""
    if not stage:
        return [v for r in range(4) for v in _hadamard(*x[4 * r : 4 * r + 4])]
    out: Block = [F.lit(0)] * 16
    for k in range(4):
        for r, v in enumerate(_hadamard(x[k], x[4 + k], x[8 + k], x[12 + k])):
            out[4 * r + k] = _s(v, 1)
    return out


def iwht(x: Block, stage: int) -> Block:
    """Inverse Walsh-Hadamard: stage 0 along columns, stage 1 along rows."""
    if not stage:
        out: Block = [F.lit(0)] * 16
        for k in range(4):
            for r, v in enumerate(_hadamard(x[k], x[4 + k], x[8 + k], x[12 + k])):
                out[4 * r + k] = v
        return out
    return [_s(v, 3) for r in range(4) for v in _hadamard(x[4 * r] + 3, *x[4 * r + 1 : 4 * r + 4])]


def quantize(v: Column, step: Column) -> Column:
    """To the nearest multiple of step, halves away from zero."""
    n = div(F.abs(v) + div(step, 2), step)
    return F.when(v < 0, -n).otherwise(n)


def avg2(x: Column, y: Column) -> Column:
    return _s(x + y + 1, 1)


def avg3(x: Column, y: Column, z: Column) -> Column:
    return _s(x + 2 * y + z + 2, 2)


#: The directional predictions of a 4x4 block: rows of taps, each two or three neighbours. p..s is the left column downwards, a the
#: corner, b..i the row above (for LD and VL that row is named a..h).
DIRECTIONS = {
    "VE": ("abc bcd cde def",) * 4,
    "HE": ("apq apq apq apq", "pqr pqr pqr pqr", "qrs qrs qrs qrs", "rss rss rss rss"),
    "RD": ("pab abc bcd cde", "qpa pab abc bcd", "rqp qpa pab abc", "srq rqp qpa pab"),
    "VR": ("ab bc cd de", "pab abc bcd cde", "qpa ab bc cd", "rqp pab abc bcd"),
    "LD": ("abc bcd cde def", "bcd cde def efg", "cde def efg fgh", "def efg fgh ghh"),
    "VL": ("ab bc cd de", "abc bcd cde def", "bc cd de efg", "bcd cde def fgh"),
    "HD": ("pa pab abc bcd", "qp qpa pa pab", "rq rqp qp qpa", "sr srq rq rqp"),
    "HU": ("pq pqr qr qrs", "qr qrs rs rss", "rs rss s s", "s s s s"),
}


def directional(mode: str, above: Block, left: Block, corner: Column) -> Block:
    """Prediction of a 4x4 block from 8 pixels above, 4 to the left and the corner."""
    names = dict(zip("pqrs", left)) | (dict(zip("abcdefgh", above)) if mode in ("LD", "VL") else {"a": corner} | dict(zip("bcdefghi", above)))
    taps = [t for row in DIRECTIONS[mode] for t in row.split()]
    return [names[t] if len(t) == 1 else avg2(*(names[c] for c in t)) if len(t) == 2 else avg3(*(names[c] for c in t)) for t in taps]


def dc_prediction(above: Column, left: Column, n: int, have_above: Column, have_left: Column) -> Column:
    """Rounded mean of the borders there are, from their sums; 128 without any."""
    both = _s(above + left + n, n.bit_length())
    one = lambda v: _s(v + n // 2, n.bit_length() - 1)
    return F.when(have_above & have_left, both).when(have_above, one(above)).when(have_left, one(left)).otherwise(F.lit(128))


def edge_two(p1: Column, p0: Column, q0: Column, q1: Column) -> tuple[Column, Column]:
    """The pixels beside an edge after the two-pixel filter."""
    a = 3 * (q0 - p0) + clamp(p1 - q1, -128, 127)
    return clamp(p0 + clamp(_s(a + 3, 3), -16, 15)), clamp(q0 - clamp(_s(a + 4, 3), -16, 15))


def edge_four(p1: Column, p0: Column, q0: Column, q1: Column) -> tuple[Column, Column, Column, Column]:
    a = 3 * (q0 - p0)
    far, near = clamp(_s(a + 4, 3), -16, 15), clamp(_s(a + 3, 3), -16, 15)
    outer = _s(far + 1, 1)
    return clamp(p1 + outer), clamp(p0 + near), clamp(q0 - far), clamp(q1 - outer)


def edge_six(p2: Column, p1: Column, p0: Column, q0: Column, q1: Column, q2: Column) -> tuple[Column, ...]:
    a = clamp(3 * (q0 - p0) + clamp(p1 - q1, -128, 127), -128, 127)
    x, y, z = (_s(k * a + 63, 7) for k in (27, 18, 9))
    return clamp(p2 + z), clamp(p1 + y), clamp(p0 + x), clamp(q0 - x), clamp(q1 - y), clamp(q2 - z)


def edge_flat(p1: Column, p0: Column, q0: Column, q1: Column, level: Column) -> Column:
    """Whether an edge is weak enough to be filtered."""
    return F.shiftleft(F.abs(p0 - q0), 1) + F.shiftright(F.abs(p1 - q1), 1) <= level
