"""The ALPH chunk: one byte of flags, then a plane, filtered and raw or as a headerless lossless stream."""

from __future__ import annotations

import numpy as np

from . import lossless
from .riff import BadFile

NONE, HORIZONTAL, VERTICAL, GRADIENT = range(4)


def apply_filter(plane: np.ndarray, kind: int) -> np.ndarray:
    p = plane.astype(np.int64)
    guess = np.zeros_like(p)
    if kind == NONE:
        return plane.copy()
    if kind == HORIZONTAL:
        guess[1:, 1:] = p[1:, :-1]
    elif kind == VERTICAL:
        guess[1:, 1:] = p[:-1, 1:]
    elif kind == GRADIENT:
        guess[1:, 1:] = np.clip(p[1:, :-1] + p[:-1, 1:] - p[:-1, :-1], 0, 255)
    else:
        raise BadFile(f"alpha filter {kind}")
    guess[0, 1:], guess[1:, 0] = p[0, :-1], p[:-1, 0]
    return ((p - guess) & 255).astype(np.uint8)


def reverse_filter(plane: np.ndarray, kind: int) -> np.ndarray:
    out = plane.astype(np.int64)
    if kind == NONE:
        return plane.copy()
    out[0] = np.cumsum(out[0])
    out[:, 0] = np.cumsum(out[:, 0])
    out &= 255
    if kind == HORIZONTAL:
        out = np.concatenate([out[:1], np.cumsum(out[1:], 1)])
    elif kind == VERTICAL:
        out = np.concatenate([out[:, :1], np.cumsum(out[:, 1:], 0)], 1)
    elif kind == GRADIENT:
        for y in range(1, out.shape[0]):
            row, up = out[y].tolist(), out[y - 1].tolist()
            for x in range(1, len(row)):
                row[x] = row[x] + min(255, max(0, row[x - 1] + up[x] - up[x - 1])) & 255
            out[y] = row
    else:
        raise BadFile(f"alpha filter {kind}")
    return (out & 255).astype(np.uint8)


def quantize(plane: np.ndarray, levels: int) -> np.ndarray:
    if not 0 < levels < 256:
        return plane.copy()
    step = 256.0 / levels
    return np.floor(np.minimum(levels - 1, np.floor(plane / step)) * step + step / 2).astype(np.uint8)


def compress(plane: np.ndarray, method: int) -> bytes:
    if method == 0:
        return plane.astype(np.uint8).tobytes()
    if method == 1:
        return lossless.encode_pixels(0xFF000000 | plane.astype(np.int64) << 8, header=False)
    raise BadFile(f"alpha method {method}")


def decompress(data: bytes, width: int, height: int, method: int) -> np.ndarray:
    if method == 0:
        if len(data) != width * height:
            raise BadFile("alpha plane of another size")
        return np.frombuffer(data, np.uint8).reshape(height, width)
    if method == 1:
        return (lossless.decode_pixels(data, (width, height)) >> 8 & 255).astype(np.uint8)
    raise BadFile(f"alpha method {method}")


def encode(plane: np.ndarray, method: int = 1, kind: int = NONE, reduce: bool = False) -> bytes:
    """The chunk's payload. reduce: to 64 levels, which the flags tell."""
    if plane.ndim != 2 or not plane.size:
        raise BadFile("an alpha plane has rows and columns")
    plane = quantize(plane, 64) if reduce else plane
    return bytes([method | kind << 2 | int(reduce) << 4]) + compress(apply_filter(plane, kind), method)


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    if not data or data[0] >> 6 or data[0] >> 4 & 3 > 1:
        raise BadFile("flags of the alpha chunk")
    return reverse_filter(decompress(data[1:], width, height, data[0] & 3), data[0] >> 2 & 3)
