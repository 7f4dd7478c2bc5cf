"""Transforms of lossless coding over pixel relations (img, i, x, y, a, r, g, b; i in row order).

Windows are always partitioned by img, so an image is one task's unit and any number of images is spread. Blocks are grouped by
(img, x >> bits, y >> bits) with partial aggregates; candidates are columns of one aggregate, never exploded rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import pixels as P


def in_order() -> WindowSpec:
    """An image's pixels in row order."""
    return Window.partitionBy("img").orderBy("i")


def with_pixel(df: DataFrame, p: P.Pixel) -> DataFrame:
    """df with its channels replaced."""
    return df.withColumns({c: v.cast("int") for c, v in zip("argb", p)})


def subtract_green(px: DataFrame) -> DataFrame:
    return with_pixel(px, P.subtract_green(P.pixel()))


def add_green(px: DataFrame) -> DataFrame:
    return with_pixel(px, P.add_green(P.pixel()))


def neighbours(px: DataFrame, width: int) -> DataFrame:
    """Adds l_, t_, c_, d_ channels: left, above, above left, above right (at the right edge: above). Outside: null."""
    at = {"l_": 1, "t_": width, "c_": width + 1, "d_": width - 1}
    out = px.withColumns({p + ch: F.lag(ch, n).over(in_order()) for p, n in at.items() for ch in "argb"})
    edge = F.col("x") == width - 1
    return out.withColumns({"d_" + ch: F.when(edge, F.col("t_" + ch)).otherwise(F.col("d_" + ch)) for ch in "argb"})


def _predicted() -> list[P.Pixel]:
    """The 14 predictions at each pixel; the first row is predicted from the left, the first column from above."""
    zero = P.Pixel(*[F.lit(0)] * 4)
    inner = P.predictions(*(P.pixel(p) for p in ("l_", "t_", "c_", "d_")))
    border = P.choose((F.col("x") == 0) & (F.col("y") == 0), zero, P.choose(F.col("y") == 0, P.pixel("l_"), P.pixel("t_")))
    return [P.choose((F.col("x") > 0) & (F.col("y") > 0), p, border) for p in inner]


def predictor_modes(px: DataFrame, width: int, bits: int) -> DataFrame:
    """img, bx, by, mode, cost: per block the first mode of least residual cost."""
    near = neighbours(px, width).withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)})
    first = (F.col("x") == 0) & (F.col("y") == 0)
    costs = {f"k{m}": F.when(first, 0).otherwise(P.residual_cost(P.subtract(P.pixel(), p))) for m, p in enumerate(_predicted())}
    sums = near.select("img", "bx", "by", *[c.alias(k) for k, c in costs.items()]).groupBy("img", "bx", "by").agg(*[F.sum(k).alias(k) for k in costs])
    least = F.least(*costs)
    return sums.select("img", "bx", "by", (F.array_position(F.array(*costs), least) - 1).cast("int").alias("mode"), least.alias("cost"))


def predictor_residual(px: DataFrame, modes: DataFrame, width: int, bits: int) -> DataFrame:
    """Pixels minus what their block's mode predicts; pixel (0, 0) stays."""
    near = neighbours(px, width).withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)}).join(modes.select("img", "bx", "by", "mode"), ["img", "bx", "by"])
    guess = reduce(lambda out, mp: P.choose(F.col("mode") == mp[0], mp[1], out), enumerate(_predicted()), P.pixel("l_"))
    first = (F.col("x") == 0) & (F.col("y") == 0)
    return with_pixel(near, P.choose(first, P.pixel(), P.subtract(P.pixel(), guess))).select(*px.columns)


def _i8(v: Column) -> Column:
    return P.clamp(v, -128, 127)


def color_coefficients(px: DataFrame, bits: int) -> DataFrame:
    """img, bx, by, g_to_r, g_to_b, r_to_b: least squares per block, signed 8-bit, truncating division."""
    block = ["img", "bx", "by"]
    own = px.withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)})
    over = Window.partitionBy(*block)
    sums = own.withColumns({"gg": F.sum(F.col("g") * F.col("g")).over(over), "gr": F.sum(F.col("g") * F.col("r")).over(over), "gb": F.sum(F.col("g") * F.col("b")).over(over)})
    slope = lambda n: F.when(F.col("gg") > 0, _i8(P.div(32 * F.col(n), F.greatest(F.col("gg"), F.lit(1))))).otherwise(0).cast("int")
    sums = sums.withColumns({"g_to_r": slope("gr"), "g_to_b": slope("gb")})
    shift = F.shiftright(F.col("g_to_r") * F.col("g"), 5)
    red = P.byte(F.col("r") - shift) + shift
    rest = F.col("b") - F.shiftright(F.col("g_to_b") * F.col("g"), 5)
    out = sums.select(*block, "g_to_r", "g_to_b", (red * red).alias("rr"), (red * rest).alias("rb")).groupBy(*block, "g_to_r", "g_to_b").agg(F.sum("rr").alias("rr"), F.sum("rb").alias("rb"))
    return out.select(*block, "g_to_r", "g_to_b", F.when(F.col("rr") > 0, _i8(P.div(32 * F.col("rb"), F.greatest(F.col("rr"), F.lit(1))))).otherwise(0).cast("int").alias("r_to_b"))


def color_transform(px: DataFrame, coefficients: DataFrame, bits: int, inverse: bool = False) -> DataFrame:
    """Decorrelates red and blue by each block's coefficients, or undoes it."""
    own = px.withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits)}).join(coefficients, ["img", "bx", "by"])
    g, r, b = F.col("g"), F.col("r"), F.col("b")
    shift = F.shiftright(F.col("g_to_r") * g, 5)
    stored = r if inverse else P.byte(r - shift)
    red = stored + shift  # not reduced modulo 256 before it corrects blue
    blue = F.shiftright(F.col("g_to_b") * g, 5) + F.shiftright(F.col("r_to_b") * red, 5)
    p = P.Pixel(F.col("a"), P.byte(red) if inverse else stored, g, P.byte(b + blue) if inverse else P.byte(b - blue))
    return with_pixel(own, p).select(*px.columns)


def palette(px: DataFrame, limit: int = 256) -> DataFrame:
    """img, argb, idx: distinct colors in order of first appearance; images with more than `limit` have none."""
    colors = px.groupBy("img", P.pack(P.pixel()).alias("argb")).agg(F.min("i").alias("first"))
    ranked = colors.withColumn("idx", F.row_number().over(Window.partitionBy("img").orderBy("first")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("img")))
    return ranked.where(F.col("n") <= limit).select("img", "argb", "idx")


def palette_indices(px: DataFrame, colors: DataFrame) -> DataFrame:
    """img, x, y, idx of every pixel of images with a palette."""
    return px.select("img", "x", "y", P.pack(P.pixel()).alias("argb")).join(colors, ["img", "argb"]).select("img", "x", "y", "idx")


def packing_bits(colors: Column) -> Column:
    """log2 of how many indices share a byte."""
    return F.when(colors <= 2, 3).when(colors <= 4, 2).when(colors <= 16, 1).otherwise(0)


def pack_indices(indices: DataFrame, xbits: int) -> DataFrame:
    """img, x, y, packed: 2**xbits neighbouring indices in one byte, low bits first."""
    each = 8 >> xbits
    place = F.col("x").bitwiseAND(F.lit((1 << xbits) - 1)) * each
    return indices.groupBy("img", "y", F.shiftright("x", xbits).alias("x")).agg(F.sum(F.call_function("shiftleft", F.col("idx").cast("long"), place)).alias("packed")).select("img", "x", "y", "packed")


def unpack_indices(packed: DataFrame, xbits: int, width: int) -> DataFrame:
    """The inverse, for images of that width."""
    each = 8 >> xbits
    k = F.explode(F.sequence(F.lit(0), F.lit((1 << xbits) - 1))).alias("k")
    rows = packed.select("img", "x", "y", "packed", k)
    at = F.shiftleft("x", xbits) + F.col("k")
    return rows.select("img", at.alias("x"), "y", F.call_function("shiftright", F.col("packed"), F.col("k") * each).bitwiseAND(F.lit((1 << each) - 1)).alias("idx")).where(F.col("x") < width)


def palette_expand(indices: DataFrame, colors: DataFrame) -> DataFrame:
    """img, x, y, argb: an index without a color is transparent black."""
    return indices.join(colors, ["img", "idx"], "left").select("img", "x", "y", F.coalesce("argb", F.lit(0).cast("long")).alias("argb"))


def palette_deltas(colors: DataFrame) -> DataFrame:
    """img, idx, a, r, g, b: each color minus the one before, modulo 256."""
    order = Window.partitionBy("img").orderBy("idx")
    own = colors.withColumns(dict(zip("argb", P.unpack(F.col("argb")))))
    return own.select("img", "idx", *[P.byte(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))).alias(c) for c in "argb"])


def palette_from_deltas(deltas: DataFrame) -> DataFrame:
    """img, idx, argb: prefix sums modulo 256."""
    order = Window.partitionBy("img").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = deltas.select("img", "idx", *[P.byte(F.sum(c).over(order)).cast("int").alias(c) for c in "argb"])
    return sums.select("img", "idx", P.pack(P.pixel()).alias("argb"))


def cache_reads(px: DataFrame, bits: int) -> DataFrame:
    """img, i, argb, slot, cached: what the color cache holds in a pixel's slot just before it (0 when nothing yet)."""
    own = px.select("img", "i", P.pack(P.pixel()).alias("argb")).withColumn("slot", P.cache_slot(F.col("argb"), bits))
    before = Window.partitionBy("img", "slot").orderBy("i")
    return own.withColumn("cached", F.coalesce(F.lag("argb").over(before), F.lit(0).cast("long")))


def histograms(px: DataFrame) -> DataFrame:
    """img, channel, sym, n: how often each value stands in each channel. One pass; four partial counts for each value."""
    rows = px.select("img", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("sym")) for c in "argb"])).alias("e"))
    return rows.groupBy("img", "e.channel", "e.sym").agg(F.count("*").alias("n"))


def canonical_codes(lengths: DataFrame, most: int = 15) -> DataFrame:
    """grp, sym, len, code, reversed: canonical prefix codes from code lengths (grp, sym, len > 0)."""
    prior = Window.partitionBy("grp").orderBy("len").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("grp", "len").orderBy("sym")
    space = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {most} - len)")).over(prior), F.lit(0))
    rows = lengths.withColumn("code", F.expr("0L") + F.call_function("shiftright", space, F.lit(most) - F.col("len")) + F.row_number().over(same) - 1)
    return rows.select("grp", "sym", "len", "code", F.conv(F.reverse(F.lpad(F.bin("code"), F.col("len"), F.lit("0"))), 2, 10).cast("long").alias("reversed"))


#: First value and extra bits of each prefix code of lengths and distances: codes 0 to 3 are the values 1 to 4, then two codes for
#: each number of extra bits, each starting where the one before ends.
def prefix_bases(codes: int) -> list[tuple[int, int]]:
    out = [(k + 1, 0) for k in range(min(codes, 4))]
    while len(out) < codes:
        extra = (len(out) - 2) >> 1
        out.append((out[-1][0] + (1 << out[-1][1]), extra))
    return out


def lz77_hash(argb: Column) -> Column:
    """The 18-bit slot of a pixel among the places that a match may begin at."""
    return P.cache_slot(argb, 18)


def distance_value(distance: Column, width: Column) -> Column:
    """The value that a distance in pixels is coded by: the first of the near places that it is, else 120 more."""
    from ..codecs.lossless import NEAR  # which takes prefix_bases from here

    places = [F.greatest(F.lit(1), (n >> 4) * width + 8 - (n & 15)).cast("long") for n in NEAR]
    at = F.array_position(F.array(*places), F.greatest(distance, F.lit(1)).cast("long"))
    return F.when(distance <= 0, 1).when(at > 0, at).otherwise(distance + 120)


def distance_histogram(references: DataFrame) -> DataFrame:
    """img, code, n: how often each distance code stands in an image's back references (img, distance, width); code 0 counts once at least."""
    rows = prefix_codes(references.select("img", distance_value(F.col("distance"), F.col("width")).alias("value")), "value", 40).select("img", "code", F.lit(1).alias("one"))
    least = references.select("img").distinct().select("img", F.lit(0).alias("code"), F.lit(0).alias("one"))
    counts = rows.unionByName(least).groupBy("img", "code").agg(F.sum("one").alias("n"))
    return counts.select("img", "code", F.when(F.col("code") == 0, F.greatest("n", F.lit(1))).otherwise(F.col("n")).alias("n"))


def stream_fits(width: Column, height: Column) -> Column:
    """Whether an image has such sizes at all: positive, and a number of pixels below 2**63."""
    return (width > 0) & (height > 0) & (width <= F.lit((1 << 63) - 1) / F.greatest(height, F.lit(1)))


def header_fits(width: Column, height: Column) -> Column:
    """Whether a stream's header can have such sizes."""
    return stream_fits(width, height) & (width <= 1 << 14) & (height <= 1 << 14)


def cache_fits(bits: Column) -> Column:
    return bits.between(1, 11)


def prefix_codes(values: DataFrame, column: str, codes: int, first: int = 0) -> DataFrame:
    """Adds code, extra_bits, extra: the code with the greatest base that is not above the value. The bases are literals, so nothing is joined."""
    bases = prefix_bases(codes)
    v = F.col(column)
    pick = lambda f: reduce(lambda out, kb: F.when(v >= kb[1][0], F.lit(f(*kb))).otherwise(out), enumerate(bases), F.lit(f(0, bases[0])))
    return values.withColumns({"code": pick(lambda k, b: k + first), "extra_bits": pick(lambda k, b: b[1]), "extra": v - pick(lambda k, b: b[0])})


#: Nearby places that the first 120 distance codes stand for, as (row above) * 16 + 8 - (columns to the left) (fixed values).
NEAR = (
    0x18, 0x07, 0x17, 0x19, 0x28, 0x06, 0x27, 0x29, 0x16, 0x1A,
    0x26, 0x2A, 0x38, 0x05, 0x37, 0x39, 0x15, 0x1B, 0x36, 0x3A,
    0x25, 0x2B, 0x48, 0x04, 0x47, 0x49, 0x14, 0x1C, 0x35, 0x3B,
    0x46, 0x4A, 0x24, 0x2C, 0x58, 0x45, 0x4B, 0x34, 0x3C, 0x03,
    0x57, 0x59, 0x13, 0x1D, 0x56, 0x5A, 0x23, 0x2D, 0x44, 0x4C,
    0x55, 0x5B, 0x33, 0x3D, 0x68, 0x02, 0x67, 0x69, 0x12, 0x1E,
    0x66, 0x6A, 0x22, 0x2E, 0x54, 0x5C, 0x43, 0x4D, 0x65, 0x6B,
    0x32, 0x3E, 0x78, 0x01, 0x77, 0x79, 0x53, 0x5D, 0x11, 0x1F,
    0x64, 0x6C, 0x42, 0x4E, 0x76, 0x7A, 0x21, 0x2F, 0x75, 0x7B,
    0x31, 0x3F, 0x63, 0x6D, 0x52, 0x5E, 0x00, 0x74, 0x7C, 0x41,
    0x4F, 0x10, 0x20, 0x62, 0x6E, 0x30, 0x73, 0x7D, 0x51, 0x5F,
    0x40, 0x72, 0x7E, 0x61, 0x6F, 0x50, 0x71, 0x7F, 0x60, 0x70,
)


def plane_distance(code: Column, width: Column) -> Column:
    """Pixels back in row order that a distance code stands for."""
    near = F.element_at(F.array(*map(F.lit, NEAR)), F.least(F.greatest(code, F.lit(1)), F.lit(120)).cast("int"))
    return F.when(code > 120, code - 120).otherwise(F.greatest(F.lit(1), F.shiftright(near, 4) * width + 8 - near.bitwiseAND(F.lit(15))))


def run_lengths(lengths: DataFrame) -> DataFrame:
    """grp, start, value, n: maximal runs of equal code lengths over (grp, sym, len)."""
    by, of = Window.partitionBy("grp").orderBy("sym"), Window.partitionBy("grp", "len").orderBy("sym")
    rows = lengths.withColumn("island", F.row_number().over(by) - F.row_number().over(of))
    return rows.groupBy("grp", "len", "island").agg(F.min("sym").alias("start"), F.count("*").alias("n")).select("grp", "start", F.col("len").alias("value"), "n")
