"""Alpha-plane operators over (img, i, x, y, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..codecs import alpha as codec
from ..functions.pixels import byte, gradient, quantize_level

FILTERS = ("none", "horizontal", "vertical", "gradient")


def in_order() -> WindowSpec:
    """A plane's values in row order."""
    return Window.partitionBy("img").orderBy("i")


def apply_filter(plane: DataFrame, width: int, kind: str) -> DataFrame:
    """v minus what the filter predicts from original neighbours, modulo 256; on the borders the neighbour there is predicts."""
    if kind == "none":
        return plane
    left, top, corner = (F.lag("v", n).over(in_order()) for n in (1, width, width + 1))
    x, y = F.col("x"), F.col("y")
    inner = {"horizontal": left, "vertical": top, "gradient": gradient(left, top, corner)}[kind]
    guess = F.when((x == 0) & (y == 0), 0).when(y == 0, left).when(x == 0, top).otherwise(inner)
    return plane.withColumn("v", byte(F.col("v") - guess))


def reverse_filter(plane: DataFrame, width: int, kind: str) -> DataFrame:
    """The inverse. Horizontal and vertical are prefix sums modulo 256; gradient depends on its own clamped output, so each plane goes
    through the codec, in Arrow batches."""
    if kind == "none":
        return plane
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if kind in ("horizontal", "vertical"):
        along, across = ("y", "x") if kind == "horizontal" else ("x", "y")
        # each line's first value is a sum over the first values of the lines before it
        edge = plane.where(F.col(across) == 0).select("img", F.col(along), byte(F.sum("v").over(up_to(Window.partitionBy("img").orderBy(along)))).alias("first"))
        line = up_to(Window.partitionBy("img", along).orderBy(across))
        inside = plane.withColumn("rest", F.sum(F.when(F.col(across) == 0, 0).otherwise(F.col("v"))).over(line))
        return inside.join(edge, ["img", along]).withColumn("v", byte(F.col("first") + F.col("rest")).cast("int")).select(*plane.columns)
    others = [c for c in plane.columns if c not in ("img", "v")]
    rows = plane.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("int").alias("v"), *[c for c in others if c != "i"]))).alias("cells"))  # one image's values
    rows = rows.select("img", "cells", F.transform("cells", lambda c: c["v"]).alias("vs"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column("vs")
            at, flat = vs.offsets.to_numpy(), vs.values.to_numpy(zero_copy_only=False)
            done = [codec.reverse_filter(flat[i:j].reshape(-1, width).astype(np.uint8), codec.GRADIENT).ravel() for i, j in zip(at[:-1], at[1:])]
            new = pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(np.concatenate([np.zeros(0, np.int32), *done]).astype(np.int32)))
            yield pa.record_batch([b.column("img"), b.column("cells"), new], ["img", "cells", "vs"])

    cells = rows.mapInArrow(run, kinds).select("img", F.explode(F.arrays_zip("cells", "vs")).alias("c"))
    kind = plane.schema["v"].dataType
    return cells.select("img", F.col("c.vs").cast(kind).alias("v"), *[F.col(f"c.cells.{c}").alias(c) for c in others]).select(*plane.columns)


def quantize(plane: DataFrame, levels: int) -> DataFrame:
    return plane.withColumn("v", quantize_level(F.col("v"), levels).cast("int"))


def extract(px: DataFrame) -> DataFrame:
    return px.select("img", "i", "x", "y", F.col("a").alias("v"))


def attach(px: DataFrame, plane: DataFrame) -> DataFrame:
    """px with a from the plane; pixels beyond a short plane are opaque."""
    return px.drop("a").join(plane.select("img", "i", F.col("v").alias("a")), ["img", "i"], "left").withColumn("a", F.coalesce("a", F.lit(255))).select(*px.columns)


def has_alpha(px: DataFrame) -> DataFrame:
    """img, has_alpha: whether any pixel is not opaque."""
    return px.groupBy("img").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))
