"""Quality metrics between two images, and checks on planes and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["img", "i"]


def _pairs(one: DataFrame, two: DataFrame, channels: str) -> DataFrame:
    return one.select(*KEY, *[F.col(c).alias("p" + c) for c in channels]).join(two.select(*KEY, *[F.col(c).alias("q" + c) for c in channels]), KEY)


def psnr(one: DataFrame, two: DataFrame, channels: str = "rgb") -> DataFrame:
    """img, mse, psnr over all channels together; equal images have 999."""
    square = sum(((F.col("p" + c) - F.col("q" + c)) * (F.col("p" + c) - F.col("q" + c)) for c in channels), F.lit(0))
    sums = _pairs(one, two, channels).groupBy("img").agg((F.sum(square) / (F.count("*") * len(channels))).alias("mse"))
    return sums.withColumn("psnr", F.when(F.col("mse") == 0, 999.0).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse"))))


def psnr_text(mse: Column) -> Column:
    """As a line for people: equal images have no number."""
    return F.when(mse == 0, "inf (lossless)").otherwise(F.format_string("%.2f dB", 10 * F.log10(F.lit(255.0 * 255.0) / mse)))


def max_abs_error(one: DataFrame, two: DataFrame, channels: str = "rgb") -> DataFrame:
    return _pairs(one, two, channels).groupBy("img").agg(F.max(F.greatest(F.lit(0), *[F.abs(F.col("p" + c) - F.col("q" + c)) for c in channels])).alias("max_error"))


def identical(one: DataFrame, two: DataFrame, channels: str = "argb") -> DataFrame:
    same = F.lit(True)
    for c in channels:
        same = same & (F.col("p" + c) == F.col("q" + c))
    return _pairs(one, two, channels).groupBy("img").agg(F.bool_and(same).alias("identical"))


def distinct_levels(plane: DataFrame) -> DataFrame:
    return plane.groupBy("img").agg(F.count_distinct("v").alias("levels"))


def kraft(lengths: DataFrame) -> DataFrame:
    """grp, kraft: the sum of 2**-len; 1 for a complete code."""
    return lengths.where(F.col("len") > 0).groupBy("grp").agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"))
