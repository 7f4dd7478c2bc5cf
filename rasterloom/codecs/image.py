"""Whole files: still pictures and animations, with alpha and metadata. Pixels are arrays (h, w, 4) of r, g, b, a."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import alpha, lossless, lossy, riff
from .riff import BadFile, Metadata

MOST_SIDE, MOST_AREA, MOST_DURATION = 1 << 24, (1 << 32) - 1, (1 << 24) - 1


def _opaque(rgba: np.ndarray) -> bool:
    return bool((rgba[..., 3] == 255).all())


def _darkened(rgba: np.ndarray) -> np.ndarray:
    """Colors as lossy coding sees them: multiplied by alpha."""
    c = rgba.astype(np.int64)
    a = c[..., 3:] * 257
    return (c[..., :3] * 257 * a // 65535 >> 8).astype(np.uint8)


def encode(rgba: np.ndarray, lossy_: bool = False, quality: float = 0.0, metadata: Metadata | None = None, tables: lossy.Tables | None = None, options: lossless.Options | None = None) -> bytes:
    """A file. Lossy pictures that are not opaque carry an alpha chunk. Without a quality lossy means the coarsest."""
    if rgba.ndim != 3 or rgba.shape[2] != 4 or not rgba.size:
        raise BadFile("pixels are rows of r, g, b, a")
    h, w = rgba.shape[:2]
    parts, flags = [], 0
    if lossy_:
        if not _opaque(rgba):
            flags |= riff.ALPHA
            parts.append(riff.chunk(b"ALPH", alpha.encode(np.ascontiguousarray(rgba[..., 3]))))
        parts.append(riff.chunk(b"VP8 ", lossy.encode_rgb(_darkened(rgba), quality, tables)))
    else:
        parts.append(riff.chunk(b"VP8L", lossless.encode_rgba(rgba, options)))
    if metadata:
        flags |= riff.ICC * bool(metadata.icc) | riff.EXIF * bool(metadata.exif) | riff.XMP * bool(metadata.xmp)
        parts = [*([riff.chunk(b"ICCP", metadata.icc)] if metadata.icc else []), *parts]
        parts += [riff.chunk(n, d) for n, d in ((b"EXIF", metadata.exif), (b"XMP ", metadata.xmp)) if d]
    if flags or metadata:
        parts.insert(0, riff.extended(flags, w, h))
    return riff.file(*parts)


def _pixels(name: bytes, payload: bytes, plane: bytes | None, tables: lossy.Tables | None) -> np.ndarray:
    if name == b"VP8L":
        return lossless.decode_rgba(payload)
    rgb = lossy.decode_rgb(payload, tables)
    h, w = rgb.shape[:2]
    a = np.full((h, w), 255, np.uint8) if plane is None else alpha.decode(plane, w, h)
    return np.dstack([rgb, a])


def decode(data: bytes, tables: lossy.Tables | None = None) -> np.ndarray:
    """Pixels; of an animation its first frame as shown. The last alpha chunk counts, wherever it stands."""
    parts = riff.chunks(data)
    if not parts:
        raise BadFile("no chunk")
    first = parts[0][0]
    if first == b"VP8X" and riff.parse_extended(parts[0][1])[0] & riff.ANIMATION:
        return compose(decode_animation(data, tables))[0]
    if first not in (b"VP8 ", b"VP8L", b"VP8X"):
        raise BadFile(f"first chunk {first!r}")
    plane = next((p for n, p in reversed(parts) if n == b"ALPH"), None) if first == b"VP8X" else None
    return _pixels(*_image(parts), plane, tables)


def _image(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    found = next(((n, p) for n, p in parts if n in (b"VP8 ", b"VP8L")), None)
    if found is None:
        raise BadFile("no image chunk")
    return found


def decode_with_metadata(data: bytes, tables: lossy.Tables | None = None) -> tuple[np.ndarray, Metadata | None]:
    """Pixels and metadata (None for simple files). Only an alpha chunk in front of the image counts; animations have no image chunk."""
    parts = riff.chunks(data)
    if not parts or parts[0][0] != b"VP8X":
        return decode(data, tables), None
    at = next((k for k, (n, _) in enumerate(parts) if n in (b"VP8 ", b"VP8L")), None)
    if at is None:
        raise BadFile("no image chunk")
    last = lambda name: next((p for n, p in reversed(parts) if n == name), None)
    plane = next((p for n, p in reversed(parts[:at]) if n == b"ALPH"), None)
    return _pixels(*parts[at], plane, tables), Metadata(last(b"ICCP"), last(b"EXIF"), last(b"XMP "))


def config(data: bytes) -> tuple[int, int, bool]:
    """(width, height, whether the picture may have alpha), without decoding."""
    parts = riff.chunks(data[:12] + data[12:])
    name, payload = parts[0] if parts else (b"", b"")
    if name == b"VP8L":
        return lossless.config(payload)
    if name == b"VP8 ":
        return (*lossy.frame_header(payload)[:2], False)
    if name != b"VP8X":
        raise BadFile(f"first chunk {name!r}")
    flags, w, h = riff.parse_extended(payload)
    if flags & (riff.ANIMATION | riff.ALPHA):
        return w, h, True
    name, payload = _image(parts)
    return lossless.config(payload) if name == b"VP8L" else (*lossy.frame_header(payload)[:2], False)


# Animations


@dataclass
class Frame:
    pixels: np.ndarray
    x: int = 0
    y: int = 0
    duration_ms: int = 0
    dispose_background: bool = False
    replace: bool = False


@dataclass
class Animation:
    """background: r, g, b, a."""

    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    loops: int = 0
    background: tuple[int, int, int, int] = (0, 0, 0, 0)


def check_canvas(w: int, h: int) -> None:
    if not (0 < w <= MOST_SIDE and 0 < h <= MOST_SIDE and w * h <= MOST_AREA):
        raise BadFile(f"canvas of {w} x {h}")


def check_frame(f: Frame, w: int, h: int) -> None:
    if f.pixels is None or f.pixels.size == 0:
        raise BadFile("a frame without a picture")
    fh, fw = f.pixels.shape[:2]
    if f.x < 0 or f.y < 0 or f.x % 2 or f.y % 2 or f.x + fw > w or f.y + fh > h:
        raise BadFile(f"frame of {fw} x {fh} at {f.x}, {f.y} on a canvas of {w} x {h}")


def encode_animation(a: Animation, lossy_: bool = False, quality: float = 0.0, tables: lossy.Tables | None = None) -> bytes:
    """Loops and background come from the animation. Lossy frames must be opaque."""
    if not a.frames:
        raise BadFile("an animation without frames")
    check_canvas(a.width, a.height)
    for f in a.frames:
        check_frame(f, a.width, a.height)
    clear = any(not _opaque(f.pixels) for f in a.frames)
    if lossy_ and clear:
        raise BadFile("lossy frames with alpha")
    r, g, b, al = a.background
    out = [riff.extended(riff.ANIMATION | riff.ALPHA * clear, a.width, a.height), riff.chunk(b"ANIM", bytes([b, g, r, al]) + struct.pack("<H", max(0, min(65535, a.loops))))]
    for f in a.frames:
        h, w = f.pixels.shape[:2]
        head = riff.u24(f.x // 2) + riff.u24(f.y // 2) + riff.u24(w - 1) + riff.u24(h - 1) + riff.u24(max(0, min(MOST_DURATION, f.duration_ms))) + bytes([int(f.dispose_background) | 2 * int(f.replace)])
        body = riff.chunk(b"VP8 ", lossy.encode_rgb(f.pixels[..., :3], quality, tables)) if lossy_ else riff.chunk(b"VP8L", lossless.encode_rgba(f.pixels))
        out.append(riff.chunk(b"ANMF", head + body))
    return riff.file(*out)


def decode_animation(data: bytes, tables: lossy.Tables | None = None) -> Animation:
    parts = riff.chunks(data)
    if not parts or parts[0][0] != b"VP8X" or not riff.parse_extended(parts[0][1])[0] & riff.ANIMATION:
        raise BadFile("not an animation")
    _, w, h = riff.parse_extended(parts[0][1])
    check_canvas(w, h)
    out, started = Animation(w, h), False
    for name, p in parts[1:]:
        if name == b"ANIM":
            if len(p) < 6:
                raise BadFile("short ANIM chunk")
            out.background, out.loops, started = (p[2], p[1], p[0], p[3]), struct.unpack_from("<H", p, 4)[0], True
        elif name == b"ANMF":
            if not started:
                raise BadFile("a frame before the animation's header")
            out.frames.append(_frame(p, w, h, tables))
    if not started:
        raise BadFile("no ANIM chunk")
    return out


def _frame(p: bytes, w: int, h: int, tables: lossy.Tables | None) -> Frame:
    if len(p) < 16 or p[15] & 0xFC:
        raise BadFile("frame header")
    inner = next(riff.walk(p[16:]), (b"", b""))
    if inner[0] not in (b"VP8 ", b"VP8L"):
        raise BadFile("a frame's first chunk is not its picture")
    f = Frame(_pixels(*inner, None, tables), 2 * riff.get24(p), 2 * riff.get24(p, 3), riff.get24(p, 12), bool(p[15] & 1), bool(p[15] & 2))
    check_frame(f, w, h)
    if f.pixels.shape[:2] != (riff.get24(p, 9) + 1, riff.get24(p, 6) + 1):
        raise BadFile("a frame's picture has another size")
    return f


def blend(dst: np.ndarray, src: np.ndarray) -> np.ndarray:
    """src over dst, not premultiplied, truncating."""
    d, s = dst.astype(np.int64), src.astype(np.int64)
    sa = s[..., 3:]
    rest = d[..., 3:] * (255 - sa) // 255
    a = sa + rest
    mixed = np.concatenate([(s[..., :3] * sa + d[..., :3] * rest) // np.maximum(a, 1), a], -1)
    return np.where(sa == 255, s, np.where(a == 0, 0, np.where(sa == 0, d, mixed))).astype(np.uint8)


def compose(a: Animation) -> list[np.ndarray]:
    """The canvas as shown at each frame."""
    canvas = np.empty((a.height, a.width, 4), np.uint8)
    canvas[:] = a.background
    out = []
    for f in a.frames:
        h, w = f.pixels.shape[:2]
        own = canvas[f.y : f.y + h, f.x : f.x + w]
        src = f.pixels[: own.shape[0], : own.shape[1]]
        own[:] = src if f.replace else blend(own, src)
        out.append(canvas.copy())
        if f.dispose_background:
            own[:] = a.background
    return out


def is_keyframe(a: Animation, k: int) -> bool:
    if k == 0:
        return True
    if not 0 < k < len(a.frames):
        return False
    f = a.frames[k]
    return f.replace and f.dispose_background and f.pixels.shape[1] >= a.width and f.pixels.shape[0] >= a.height
