"""Steps of lossy coding over planes and blocks.

A blocks relation has the 16 values of a 4x4 block as columns (prefix 0..15), which keeps transforms inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import pixels as P


def padded(px: DataFrame, width: int, height: int, to: int = 16) -> DataFrame:
    """px extended to multiples of `to` by repeating the last column and row. Edge pixels are exploded; nothing is joined."""
    w, h = -(-width // to) * to, -(-height // to) * to
    span = lambda c, last, end: F.when(F.col(c) == last, F.sequence(F.lit(last), F.lit(end - 1))).otherwise(F.array(F.col(c)))
    rows = px.withColumn("x", F.explode(span("x", width - 1, w))).withColumn("y", F.explode(span("y", height - 1, h)))
    return rows.withColumn("i", F.col("y") * w + F.col("x"))


def luma_chroma(px: DataFrame) -> DataFrame:
    """img, x, y, yy, cb, cr of every pixel."""
    y, cb, cr = P.rgb_to_ycc(F.col("r"), F.col("g"), F.col("b"))
    return px.select("img", "x", "y", y.alias("yy"), cb.alias("cb"), cr.alias("cr"))


def chroma(ycc: DataFrame) -> DataFrame:
    """img, x, y, cb, cr at half size: the top left sample of each 2x2."""
    return ycc.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select("img", F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), "cb", "cr")


def _staged(df: DataFrame, keep: list[str], *stages) -> DataFrame:
    """Applies block functions one after another; each result is a projection of named columns. The last is named o0..o15."""
    for k, (f, prefix) in enumerate(stages):
        out = "o" if k == len(stages) - 1 else f"t{k}_"
        df = df.select(*keep, *[v.cast("int").alias(f"{out}{n}") for n, v in enumerate(f(B.columns(prefix)))])
    return df


def fdct(blocks: DataFrame, keep: list[str], prefix: str = "c") -> DataFrame:
    return _staged(blocks, keep, (B.fdct_rows, prefix), (B.fdct_columns, "t0_"))


def idct(blocks: DataFrame, keep: list[str], prefix: str = "c") -> DataFrame:
    """Residuals; add a prediction and clamp to have pixels."""
    return _staged(blocks, keep, (B.idct_columns, prefix), (B.idct_rows, "t0_"))


def fwht(blocks: DataFrame, keep: list[str], prefix: str = "c") -> DataFrame:
    return _staged(blocks, keep, (lambda x: B.fwht(x, 0), prefix), (lambda x: B.fwht(x, 1), "t0_"))


def iwht(blocks: DataFrame, keep: list[str], prefix: str = "c") -> DataFrame:
    return _staged(blocks, keep, (lambda x: B.iwht(x, 0), prefix), (lambda x: B.iwht(x, 1), "t0_"))


def quantized(blocks: DataFrame, keep: list[str], dc: Column, ac: Column, prefix: str = "c") -> DataFrame:
    return blocks.select(*keep, *[B.quantize(F.col(f"{prefix}{k}"), ac if k else dc).cast("int").alias(f"o{k}") for k in range(16)])


def dequantized(blocks: DataFrame, keep: list[str], dc: Column, ac: Column, prefix: str = "c") -> DataFrame:
    return blocks.select(*keep, *[(F.col(f"{prefix}{k}") * (ac if k else dc)).cast("int").alias(f"o{k}") for k in range(16)])


def steps(index: Column) -> tuple[Column, Column]:
    """(dc, ac) steps of a quantiser index, from literal arrays."""
    at = (P.clamp(index, 0, 127) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, B.DC_STEPS)), at), F.element_at(F.array(*map(F.lit, B.AC_STEPS)), at)


def quantizers(index: Column, deltas: tuple[int, int, int, int, int] = (0, 0, 0, 0, 0)) -> dict[str, Column]:
    """The six steps of a segment; deltas are those of luma DC, second-order DC and AC, chroma DC and AC."""
    base = P.clamp(index, 0, 127)
    at = lambda d, most=127: P.clamp(base + d, 0, 127) if most == 127 else F.least(F.lit(most), P.clamp(base + d, 0, 127))
    y2ac = P.div(steps(at(deltas[2]))[1] * 155, 100)
    return {
        "y_dc": steps(at(deltas[0]))[0], "y_ac": steps(base)[1], "y2_dc": steps(at(deltas[1]))[0] * 2, "y2_ac": F.greatest(F.lit(8), y2ac),
        "uv_dc": steps(at(deltas[3], 117))[0], "uv_ac": steps(at(deltas[4]))[1],
    }


def best_mode(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """key, mode, sad: of DC, vertical, horizontal and gradient prediction of an n x n block the first legal one with the least
    sum of differences.

    rows: key, v, above, left (the border pixels of v's column and row), corner, sum_above, sum_left, have_above, have_left.
    """
    va, vl = F.col("have_above"), F.col("have_left")
    guesses = [B.dc_prediction(F.col("sum_above"), F.col("sum_left"), n, va, vl), F.col("above"), F.col("left"), P.gradient(F.col("left"), F.col("above"), F.col("corner"))]
    legal = [F.lit(True), va, vl, va & vl]
    sums = rows.groupBy(*key).agg(*[F.sum(F.when(ok, F.abs(F.col("v") - g))).alias(f"s{k}") for k, (ok, g) in enumerate(zip(legal, guesses))])
    least = F.least(*[F.col(f"s{k}") for k in range(4)])
    return sums.select(*key, (F.array_position(F.array(*[F.coalesce(f"s{k}", F.lit(1 << 60)) for k in range(4)]), least) - 1).cast("int").alias("mode"), least.alias("sad"))


def line_predictions(rows: DataFrame) -> DataFrame:
    """Adds vertical and horizontal: what a block's pixels are by the border's value of their column, or of their row."""
    return rows.withColumns({"vertical": F.col("above"), "horizontal": F.col("left")})


def filter_limits(level: Column, sharpness: Column, key_frame: Column) -> dict[str, Column]:
    """level, ilevel, hlevel of the loop filter from a macroblock's level (after deltas)."""
    level = F.least(level, F.lit(63))
    sharp = F.when(sharpness > 4, F.shiftright(level, 2)).when(sharpness > 0, F.shiftright(level, 1)).otherwise(level)
    inner = F.greatest(F.lit(1), F.when(sharpness > 0, F.least(sharp, 9 - sharpness)).otherwise(sharp))
    high = F.when(key_frame, F.when(level < 15, 0).when(level < 40, 1).otherwise(2)).otherwise(F.when(level < 15, 0).when(level < 20, 1).when(level < 40, 2).otherwise(3))
    on = level > 0
    return {k: F.when(on, v).otherwise(0) for k, v in (("level", 2 * level + inner), ("ilevel", inner), ("hlevel", high))}


def token_category(v: Column) -> Column:
    """Name of the token that codes a coefficient: zero, one to four, or a category with extra bits."""
    m = F.abs(v)
    names = ((1, "zero"), (2, "one"), (3, "two"), (4, "three"), (5, "four"), (7, "cat1"), (11, "cat2"), (19, "cat3"), (35, "cat4"), (67, "cat5"))
    out = F.lit("cat6")
    for below, name in reversed(names):
        out = F.when(m < below, name).otherwise(out)
    return out
