"""Animation frames as rows: (anim, frame_no, x, y, w, h, duration_ms, dispose, blend); pixels join on (anim, frame_no).

Composition is independent for every canvas pixel, so frames are exploded to pixels, gathered by (anim, x, y) and folded in order:
parallel over pixels, and one task holds one pixel's history at a time, never an animation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import image

NONE, BACKGROUND = 0, 1  # dispose
ALPHA, REPLACE = 0, 1  # blend
MOST_SIDE, MOST_AREA = 1 << 24, (1 << 32) - 1


def canvas_fits(w: Column, h: Column) -> Column:
    return (w > 0) & (h > 0) & (w <= MOST_SIDE) & (h <= MOST_SIDE) & (w.cast("long") * h.cast("long") <= MOST_AREA)


def frame_fits(f: dict[str, Column], canvas_w: Column, canvas_h: Column) -> Column:
    """Offsets even and not negative, a positive size, inside the canvas."""
    even = (f["x"] % 2 == 0) & (f["y"] % 2 == 0)
    return (f["x"] >= 0) & (f["y"] >= 0) & even & (f["w"] > 0) & (f["h"] > 0) & (f["x"] + f["w"] <= canvas_w) & (f["y"] + f["h"] <= canvas_h)


def keyframe(frame_no: Column, blend_: Column, dispose: Column, w: Column, h: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """Whether what is shown doesn't depend on earlier frames (by the format's strict reading, with its own disposal)."""
    return (frame_no == 0) | (blend_ == REPLACE) & (dispose == BACKGROUND) & (w >= canvas_w) & (h >= canvas_h)


def compose(layers: DataFrame, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """anim, frame_no, x, y, a, r, g, b: the canvas as shown at each frame that touches the pixel.

    layers: anim, frame_no, x, y (on the canvas), a, r, g, b, dispose, blend. Frames that don't touch a pixel leave it as it was after the
    last that did, so only touching frames are rows. A batch's pixels take their first layers at once, then their second ones, and so on:
    the work is one step for each layer.
    """
    names, fields = ("anim", "x", "y"), ("a", "r", "g", "b", "dispose", "blend")
    layer = F.struct("frame_no", *[F.col(c).cast("int").alias(c) for c in fields])
    rows = layers.groupBy(*names).agg(F.sort_array(F.collect_list(layer)).alias("layers"))  # one pixel's history
    kind = {f.name: f.dataType.simpleString() for f in layers.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("layers")
            at, flat = own.offsets.to_numpy().astype(np.int64), own.values
            each = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in fields}
            src = np.stack([each[c] for c in "rgba"], 1).astype(np.uint8)
            shown, many = np.empty_like(src), np.diff(at)
            now = np.tile(np.array([*background[1:], background[0]], np.uint8), (len(many), 1))
            clear = now[:1].copy()
            for k in range(int(many.max(initial=0))):
                live = np.flatnonzero(many > k)
                place = at[live] + k
                shown[place] = np.where((each["blend"][place] == ALPHA)[:, None], image.blend(now[live], src[place]), src[place])
                now[live] = np.where((each["dispose"][place] == BACKGROUND)[:, None], clear, shown[place])
            take = pa.array(np.repeat(np.arange(len(many)), many))
            part = slice(int(at[0]), int(at[-1]))
            columns = [b.column("anim").take(take), flat.field("frame_no").slice(part.start, part.stop - part.start), b.column("x").take(take), b.column("y").take(take)]
            yield pa.record_batch([*columns, *(pa.array(shown[part, c].astype(np.int32)) for c in (3, 0, 1, 2))], ["anim", "frame_no", "x", "y", *"argb"])

    return rows.mapInArrow(run, f"anim {kind['anim']}, frame_no {kind['frame_no']}, x {kind['x']}, y {kind['y']}, a int, r int, g int, b int")
