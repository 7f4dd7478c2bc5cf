"""Media columns: byte payloads stored as 8-bit grey PNG in a binary column, read back and described by a cosine-transform hash.

The codec is written here on zlib and numpy: chunks carry CRC-32, which decode() tests. The writer chooses among three filters for each row
(none, left, up, which are undone for runs of rows at once); the reader undoes all five.
Nulls and empty texts are one block of padding. Equal texts give equal media and equal features. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, small_batches, staged, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCK = 576  # bytes; also the width of a picture
PAD = 255  # never a byte of UTF-8, so the padding can be told from the text
SIDE, LOW = 32, 8  # the picture is averaged to SIDE x SIDE; LOW x LOW coefficients are kept


class BadMedia(ValueError):
    """The stored bytes are not a PNG of the kind written here, or a checksum does not hold."""


def padded(data: bytes) -> bytes:
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    return data + bytes([PAD]) * (size - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    left, up, corner = (x.astype(np.int16) for x in (left, up, corner))
    if kind == 3:
        return (left + up) >> 1
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """rows (height, width) with one filter applied to all of them, the filter byte in front of each."""
    left = np.pad(rows, ((0, 0), (1, 0)))[:, :-1]
    up = np.pad(rows, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(rows, ((1, 0), (1, 0)))[:-1, :-1]
    guess = (np.zeros_like(rows), left, up)[kind] if kind < 3 else _predicted(kind, left, up, corner).astype(np.uint8)
    return np.insert(rows - guess, 0, kind, axis=1)


def unfiltered(raw: np.ndarray) -> np.ndarray:
    """The inverse for any mixture of the five filters; runs of rows with one of the simple filters are undone at once."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise BadMedia("unknown row filter")
    at = 0
    while at < len(rows):
        kind, end = kinds[at], at + 1
        while end < len(rows) and kinds[end] == kind and kind < 3:
            end += 1
        part = rows[at:end]
        if kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == 2:
            if at:
                part[0] += rows[at - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind > 2:
            above = rows[at - 1] if at else np.zeros_like(rows[0])
            left = corner = np.uint8(0)
            for x in range(rows.shape[1]):
                part[0, x] = left = np.uint8((int(part[0, x]) + int(_predicted(kind, np.array(left), above[x], np.array(corner)))) & 255)
                corner = above[x]
        at = end
    return rows


def best_filtered(rows: np.ndarray) -> np.ndarray:
    """Each row with that of the filters none, left and up whose bytes, as signed numbers, have the least sum of sizes (the first of equal ones)."""
    made = np.stack([filtered(rows, kind) for kind in range(3)])
    cost = np.abs(made[:, :, 1:].view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    return made[cost.argmin(axis=0), np.arange(len(rows))]


def encode(payload: bytes, row_filter: int | None = None, level: int = 6) -> bytes:
    """A payload of whole blocks as a grey PNG of BLOCK samples a row. row_filter: one for all rows; without it each row has its own."""
    if not payload or len(payload) % BLOCK:
        raise BadMedia("the payload must be a positive number of whole blocks")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress((best_filtered(rows) if row_filter is None else filtered(rows, row_filter)).tobytes(), level)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """The samples as (height, width) uint8. Raises BadMedia where signature, order, a checksum or a size does not hold."""
    if png[:8] != SIGNATURE:
        raise BadMedia("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise BadMedia("cut chunk")
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png) or zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise BadMedia(f"checksum or size of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise BadMedia("not a whole 8-bit grey picture")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != height * (width + 1):
        raise BadMedia("wrong number of samples")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@lru_cache
def _cosines() -> np.ndarray:
    u, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * (2 * x + 1) * u / (2 * SIDE))


def cosine_hash(picture: np.ndarray) -> str:
    """64 bits as hex: which of the lowest LOW x LOW cosine coefficients lie above their median."""
    height, width = picture.shape
    small = picture.reshape(height, SIDE, width // SIDE).mean(axis=2)
    if height >= SIDE:
        edges = np.arange(SIDE + 1) * height // SIDE
        small = np.add.reduceat(small, edges[:-1], axis=0) / np.diff(edges)[:, None]
    else:
        small = small[np.arange(SIDE) * height // SIDE]
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _encoded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        data, at = utf8(b.column(1))
        data = data.tobytes()
        own = [data[i:j] for i, j in zip(at[:-1], at[1:])]
        yield pa.record_batch([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([encode(padded(x)) for x in own], pa.binary())], ["doc_id", "n_bytes", "media"])


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the encoded media of every text, written to the shared folder and read again. Other columns of docs are left out."""
    small_batches(docs.sparkSession)
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary"), codec="uncompressed")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        found = []
        for png in b.column(2).to_pylist():
            picture = decode(png)
            back = picture.tobytes()
            found.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(picture)))
        columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored media back: sizes, digests and the hash of every row."""
    return media.mapInArrow(_described, FEATURES)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(write_media(read(spark, sf_dir, "documents")))
