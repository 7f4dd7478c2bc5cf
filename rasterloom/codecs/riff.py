"""The container: RIFF chunks in memory. Declared file sizes are not checked and a cut last chunk is left out, as readers of it do."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

ICC, ALPHA, EXIF, XMP, ANIMATION = 1 << 5, 1 << 4, 1 << 3, 1 << 2, 1 << 1


class BadFile(ValueError):
    """The bytes are not a file of this format, or hold what it doesn't allow."""


def chunk(name: bytes, payload: bytes) -> bytes:
    return name + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)


def file(*chunks: bytes) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def walk(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, payload) of chunks in order; a chunk whose payload is cut ends the walk, a missing last pad byte does not."""
    at = 0
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        if at + 8 + size > len(data):
            return
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadFile("not a RIFF/WEBP file")
    return list(walk(data[12:]))


def u24(v: int) -> bytes:
    return struct.pack("<I", v)[:3]


def get24(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 3], "little")


def extended(flags: int, width: int, height: int) -> bytes:
    return chunk(b"VP8X", struct.pack("<I", flags) + u24(width - 1) + u24(height - 1))


def parse_extended(payload: bytes) -> tuple[int, int, int]:
    if len(payload) < 10:
        raise BadFile("short VP8X chunk")
    return struct.unpack_from("<I", payload)[0], get24(payload, 4) + 1, get24(payload, 7) + 1


@dataclass
class Metadata:
    """Uninterpreted bytes, or None."""

    icc: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None

    def __bool__(self) -> bool:
        return bool(self.icc or self.exif or self.xmp)
