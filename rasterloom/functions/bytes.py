"""Little-endian numbers and chunk framing in BINARY columns, as expressions.

Bytes are read and made one by one through hexadecimal, which is exact for every value (reversing a binary column is not).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, at: int | Column) -> Column:
    """The byte at an offset from 0; null beyond the end."""
    start = (at + 1) if isinstance(at, Column) else F.lit(at + 1)
    part = F.substring(data, start, F.lit(1))
    return F.when(F.octet_length(part) == 1, F.conv(F.hex(part), 16, 10).cast("long"))


def number_at(data: Column, at: int | Column, size: int) -> Column:
    """A little-endian unsigned number of `size` bytes."""
    return reduce(lambda a, b: a + b, [byte_at(data, at + k) * (1 << (8 * k)) for k in range(size)])


def number(value: Column, size: int) -> Column:
    """The bytes of a number, least significant first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(size)]))


def literal(text: str) -> Column:
    return F.lit(text.encode("ascii"))


def fourcc(data: Column, at: int = 0) -> Column:
    return F.substring(data, F.lit(at + 1), F.lit(4)).cast("string")


def chunk(name: str | Column, payload: Column) -> Column:
    """Name, size, payload and a zero byte if the size is odd."""
    size = F.octet_length(payload)
    return F.concat(literal(name) if isinstance(name, str) else name, number(size, 4), payload, F.when(size % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))


def chunk_size(payload_size: Column) -> Column:
    return 8 + payload_size + payload_size % 2


def file_header(size: Column) -> Column:
    """The 12 bytes in front of the chunks; size counts what follows the size field."""
    return F.concat(literal("RIFF"), number(size, 4), literal("WEBP"))


def is_webp(data: Column) -> Column:
    return (fourcc(data) == "RIFF") & (fourcc(data, 8) == "WEBP")


#: Bits of the extended header's flags (fixed values).
FLAGS = {"icc": 5, "alpha": 4, "exif": 3, "xmp": 2, "animation": 1}


def has_flag(flags: Column, name: str) -> Column:
    return F.shiftright(flags, FLAGS[name]).bitwiseAND(F.lit(1)) == 1


def extended_payload(flags: Column, width: Column, height: Column) -> Column:
    return F.concat(number(flags, 4), number(width - 1, 3), number(height - 1, 3))


def parse_extended(payload: Column) -> dict[str, Column]:
    return {"flags": number_at(payload, 0, 4), "width": number_at(payload, 4, 3) + 1, "height": number_at(payload, 7, 3) + 1}


def animation_payload(blue: Column, green: Column, red: Column, alpha: Column, loops: Column) -> Column:
    return F.concat(*[number(v, 1) for v in (blue, green, red, alpha)], number(F.greatest(F.lit(0), F.least(F.lit(65535), loops)), 2))


def parse_animation(payload: Column) -> dict[str, Column]:
    return {**{c: byte_at(payload, k) for k, c in enumerate(("blue", "green", "red", "alpha"))}, "loops": number_at(payload, 4, 2)}


def frame_header(x: Column, y: Column, w: Column, h: Column, duration: Column, dispose: Column, replace: Column) -> Column:
    """The 16 bytes in front of a frame's chunks; offsets are stored halved."""
    duration = F.greatest(F.lit(0), F.least(F.lit(16777215), duration))
    return F.concat(number(F.shiftright(x, 1), 3), number(F.shiftright(y, 1), 3), number(w - 1, 3), number(h - 1, 3), number(duration, 3), number(dispose + 2 * replace, 1))


def parse_frame(payload: Column) -> dict[str, Column]:
    flags = byte_at(payload, 15)
    return {
        "x": number_at(payload, 0, 3) * 2, "y": number_at(payload, 3, 3) * 2, "w": number_at(payload, 6, 3) + 1, "h": number_at(payload, 9, 3) + 1, "duration_ms": number_at(payload, 12, 3),
        "dispose": flags.bitwiseAND(F.lit(1)), "blend": F.shiftright(flags, 1).bitwiseAND(F.lit(1)),
    }


def parse_alpha_header(b: Column) -> dict[str, Column]:
    two = lambda n: F.shiftright(b, n).bitwiseAND(F.lit(3))
    return {"method": two(0), "filter": two(2), "preprocessing": two(4)}


def alpha_header(method: Column, filter_: Column, preprocessing: Column) -> Column:
    return number(method + 4 * filter_ + 16 * preprocessing, 1)


def lossless_config(payload: Column) -> dict[str, Column]:
    """Size, alpha bit and version from the first 5 bytes of a lossless stream."""
    bits = number_at(payload, 1, 4)
    at = lambda n, size: F.shiftright(bits, n).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    return {"width": at(0, 14) + 1, "height": at(14, 14) + 1, "has_alpha": at(28, 1) == 1, "valid": (byte_at(payload, 0) == 0x2F) & (at(29, 3) == 0)}


def lossy_config(payload: Column) -> dict[str, Column]:
    """Frame tag and size from the first 10 bytes of a lossy key frame."""
    tag = number_at(payload, 0, 3)
    size = lambda at: number_at(payload, at, 2)
    low = lambda v, n: v.bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    start = (byte_at(payload, 3) == 0x9D) & (byte_at(payload, 4) == 0x01) & (byte_at(payload, 5) == 0x2A)
    return {
        "key_frame": low(tag, 1) == 0, "version": low(F.shiftright(tag, 1), 3), "show": low(F.shiftright(tag, 4), 1) == 1, "part_size": F.shiftright(tag, 5), "width": low(size(6), 14),
        "x_scale": F.shiftright(size(6), 14), "height": low(size(8), 14), "y_scale": F.shiftright(size(8), 14), "valid": start,
    }


def lossy_header(part_size: Column, width: Column, height: Column) -> Column:
    """The 10 bytes in front of a shown key frame of version 0."""
    return F.concat(number(F.shiftleft(part_size, 5) + 16, 3), F.lit(b"\x9d\x01\x2a"), number(width, 2), number(height, 2))


def image_config(content: Column) -> dict[str, Column]:
    """codec, width, height, alpha of a file from its first 30 bytes, without decoding: prunes to a header read."""
    kind = fourcc(content, 12)
    body = F.substring(content, F.lit(21), F.lit(10))
    less, loss, ext = lossless_config(body), lossy_config(body), parse_extended(body)
    pick = lambda a, b, c: F.when(~is_webp(content), None).when(kind == "VP8L", a).when(kind == "VP8 ", b).when(kind == "VP8X", c)
    return {
        "codec": F.when(is_webp(content) & kind.isin("VP8L", "VP8 ", "VP8X"), F.trim(kind)), "width": pick(less["width"], loss["width"], ext["width"]), "height": pick(less["height"], loss["height"], ext["height"]),
        "alpha": pick(less["has_alpha"], F.lit(False), has_flag(ext["flags"], "alpha") | has_flag(ext["flags"], "animation")),
    }


# Bit strings: text of 0 and 1, most significant bit of each byte first.


def bits_of(data: Column) -> Column:
    return F.array_join(F.transform(F.split(F.hex(data), ""), lambda c: F.lpad(F.bin(F.conv(c, 16, 10).cast("long")), 4, "0")), "")


def read_bits(bits: Column, at: Column, n: int) -> Column:
    return F.conv(F.substring(bits, at + 1, F.lit(n)), 2, 10).cast("long")


def read_bits_low_first(bits: Column, at: Column, n: int) -> Column:
    return F.conv(F.reverse(F.substring(bits, at + 1, F.lit(n))), 2, 10).cast("long")


def aligned(at: Column) -> Column:
    """The place of the next byte's first bit, or at itself where it is one."""
    return F.floor((at + 7) / 8) * 8


def write_bits(value: Column, n: int) -> Column:
    return F.lpad(F.bin(value), n, "0")


def write_bits_low_first(value: Column, n: int) -> Column:
    return F.reverse(F.lpad(F.bin(value), n, "0"))


def flushed(bits: Column) -> Column:
    """Bytes of a bit string, the last filled with zeros."""
    size = F.length(bits)
    whole = F.rpad(bits, (size + (8 - size % 8) % 8).cast("int"), F.lit("0"))
    fours = F.sequence(F.lit(0), (F.length(whole) / 4 - 1).cast("int"))
    return F.when(size == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(F.transform(fours, lambda k: F.conv(F.substring(whole, k * 4 + 1, F.lit(4)), 2, 16)), "")))
