"""PNG in and out for conversions: 8-bit grey, RGB, palette and RGBA, not interlaced. Written on zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    raw = np.insert(rgba.reshape(h, 4 * w), 0, 0, axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _rows(raw: bytes, h: int, size: int, bpp: int) -> np.ndarray:
    out, at = np.zeros((h, size), np.uint8), 0
    above = np.zeros(size, np.int64)
    for y in range(h):
        kind, row = raw[at], np.frombuffer(raw, np.uint8, size, at + 1).astype(np.int64)
        at += size + 1
        if kind == 2:
            row = row + above
        elif kind == 1:
            row = row.reshape(-1, bpp).cumsum(0).ravel()
        elif kind:
            cells, up = row.tolist(), above.tolist()
            for x in range(size):
                a, b, c = (cells[x - bpp] if x >= bpp else 0), up[x], (up[x - bpp] if x >= bpp else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                cells[x] = cells[x] + guess & 255
            row = np.array(cells)
        above = row & 255
        out[y] = above
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels (h, w, 4)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, parts, palette, clear, head = 8, [], None, b"", None
    while at + 12 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("PNG checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("only 8-bit PNG files that are not interlaced are read")
    w, h, n = head[0], head[1], CHANNELS[head[3]]
    p = _rows(zlib.decompress(b"".join(parts)), h, w * n, n).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if head[3] == 3:
        out[..., :3] = palette[p[..., 0]]
        a = np.full(256, 255, np.uint8)
        a[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., 3] = a[p[..., 0]]
    else:
        out[..., :3] = p[..., :3] if n > 2 else p[..., :1]
        if n in (2, 4):
            out[..., 3] = p[..., -1]
    return out
