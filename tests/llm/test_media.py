import hashlib
import zlib

import numpy as np
import pytest

from rasterloom.llm import media


@pytest.mark.parametrize("kind", range(5))
def test_round_trip_of_every_filter(kind):
    payload = np.random.default_rng(kind).integers(0, 256, 3 * media.BLOCK).astype(np.uint8).tobytes()
    assert media.decode(media.encode(payload, kind)).tobytes() == payload


def test_mixed_filters():
    rows = np.random.default_rng(9).integers(0, 256, (12, 20)).astype(np.uint8)
    raw = np.array([media.filtered(rows, k % 5)[k] for k in range(12)])
    assert (media.unfiltered(raw) == rows).all()


def plain_png(png):
    """Samples of an 8-bit grey PNG, sample by sample as its specification has it."""
    import struct

    at, idat = 8, b""
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows, kinds = zlib.decompress(idat), [], set()
    for y in range(height):
        line, above, own = raw[y * (width + 1) : (y + 1) * (width + 1)], rows[-1] if rows else [0] * width, []
        kinds.add(line[0])
        for x in range(width):
            a, b, c = own[-1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[line[0]]
            own.append((line[1 + x] + guess) % 256)
        rows.append(own)
    return bytes(v for r in rows for v in r), kinds


def plain_hash(payload):
    """The feature from the definition of the cosine transform."""
    from math import cos, pi

    width, side, low = 576, 32, 8
    rows = [payload[i : i + width] for i in range(0, len(payload), width)]
    narrow = [[sum(r[x * 18 : x * 18 + 18]) / 18 for x in range(side)] for r in rows]
    h = len(rows)
    if h >= side:
        edge = [k * h // side for k in range(side + 1)]
        small = [[sum(narrow[y][x] for y in range(i, j)) / (j - i) for x in range(side)] for i, j in zip(edge, edge[1:])]
    else:
        small = [narrow[k * h // side] for k in range(side)]
    found = [round(sum(small[y][x] * cos(pi * (2 * y + 1) * u / 64) * cos(pi * (2 * x + 1) * v / 64) for y in range(side) for x in range(side)), 6) for u in range(low) for v in range(low)]
    rest = sorted(found[1:])
    return sum((v > rest[31]) << (63 - k) for k, v in enumerate(found))


def test_another_reader_gives_the_same():
    rng = np.random.default_rng(5)
    smooth = (np.add.outer(np.arange(40) * 3, np.arange(576) // 4) % 256).astype(np.uint8).tobytes()
    text = media.padded(" ".join(f"w{k}" for k in rng.integers(0, 50, 900)).encode())
    kinds = set()
    for payload in (smooth, text, media.padded(b""), rng.integers(0, 256, 5 * 576).astype(np.uint8).tobytes()):
        png = media.encode(payload)
        back, used = plain_png(png)
        kinds |= used
        assert back == payload == media.decode(png).tobytes()
        differ = int(media.cosine_hash(media.decode(png)), 16) ^ plain_hash(payload)
        assert differ.bit_count() <= 1  # the two may round the median's neighbours differently
    assert len(kinds) > 1


def test_damage_is_found():
    png = media.encode(media.padded(b"some text"))
    for at in range(len(png)):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(media.BadMedia):
            media.decode(bytes(bad))
    for cut in (0, 7, 20, len(png) - 1):
        with pytest.raises(media.BadMedia):
            media.decode(png[:cut])


def test_features(docs, corpus, no_docs):
    rows = {r.doc_id: r for r in media.media_features(media.write_media(docs)).collect()}
    by_text = {}
    for i, t in corpus:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        png = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert by_text.setdefault(t or "", (r.feature, r.media_sha256)) == (r.feature, r.media_sha256) and len(r.feature) == 16
    assert media.media_features(media.write_media(no_docs)).count() == 0


def test_hash_is_of_the_low_frequencies():
    y, x = np.mgrid[0:64, 0:576]
    a = (128 + 100 * np.cos(np.pi * x / 576)).astype(np.uint8)
    noisy = np.clip(a.astype(int) + np.random.default_rng(1).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    other = (128 + 100 * np.cos(np.pi * y / 8)).astype(np.uint8)
    bits = lambda p: np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(p)), np.uint8))
    assert bits(a)[1] == bits(noisy)[1] == 1 and bits(other)[1] == 0
