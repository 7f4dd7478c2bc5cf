"""Encoding and decoding of binary columns, in Arrow batches. A bad file gives an error text in its row, never a failed job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import image
from ..codecs.lossy import Tables

#: Pictures in one Arrow batch; a decoded picture is one row. Pixels in one batch of a pixel relation.
BATCH, PIXELS = 32, 1 << 18


def small_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df


def _schema(df: DataFrame, drop: set[str], add: str) -> tuple[list[str], str]:
    keep = [f for f in df.schema.fields if f.name not in drop]
    return [f.name for f in keep], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), add])


def decode(files: DataFrame, column: str = "content", tables: Tables | None = None) -> DataFrame:
    """files with width, height, rgba (bytes in row order) and error instead of the column."""
    small_batches(files)
    names, schema = _schema(files, {column, "width", "height", "rgba", "error"}, "width int, height int, rgba binary, error string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for data in b.column(column).to_pylist():
                try:
                    p = image.decode(data, tables)
                    out.append((p.shape[1], p.shape[0], p.astype(np.uint8).tobytes(), None))
                except (ValueError, TypeError) as e:
                    out.append((None, None, None, str(e) or type(e).__name__))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.record_batch([*(b.column(n) for n in names), *columns], [*names, "width", "height", "rgba", "error"])

    return files.mapInArrow(run, schema)


def encode(pictures: DataFrame, lossy: bool = False, quality: float = 0.0, tables: Tables | None = None) -> DataFrame:
    """pictures (width, height, rgba, ...) with content and error instead of the pixels."""
    small_batches(pictures)
    names, schema = _schema(pictures, {"rgba", "content", "error"}, "content binary, error string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for w, h, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "rgba"))):
                try:
                    out.append((image.encode(np.frombuffer(data, np.uint8).reshape(h, w, 4), lossy, quality, tables=tables), None))
                except (ValueError, TypeError) as e:
                    out.append((None, str(e) or type(e).__name__))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), ()), (pa.binary(), pa.string()))]
            yield pa.record_batch([*(b.column(n) for n in names), *columns], [*names, "content", "error"])

    return pictures.mapInArrow(run, schema)


def gathered(px: DataFrame, width: int, height: int) -> DataFrame:
    """img, width, height, rgba of a pixel relation: one row for each picture."""
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    cell = F.struct("i", F.concat(*[byte(F.col(c)) for c in "rgba"]).alias("s"))
    rows = px.groupBy("img").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # one picture's pixels
    return rows.select("img", F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(F.array_join(F.transform("cells", lambda c: c["s"]), "")).alias("rgba"))


def exploded(pictures: DataFrame) -> DataFrame:
    """The pixel relation of decoded pictures (img, width, height, rgba)."""
    kind = pictures.schema["img"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k, (width, data) in enumerate(zip(b.column("width").to_pylist(), b.column("rgba").to_pylist())):
                p = np.frombuffer(data or b"", np.uint8).reshape(-1, 4).astype(np.int32)
                img = b.column("img").slice(k, 1)
                for low in range(0, len(p), PIXELS):
                    part = p[low : low + PIXELS]
                    i = np.arange(low, low + len(part), dtype=np.int32)
                    own = img.take(pa.array(np.zeros(len(part), np.int32)))
                    yield pa.record_batch([own, *(pa.array(np.ascontiguousarray(c)) for c in (i, i % width, i // width, part[:, 3], part[:, 0], part[:, 1], part[:, 2]))], ["img", *"ixyargb"])

    return small_batches(pictures).select("img", "width", "rgba").mapInArrow(run, f"img {kind}, i int, x int, y int, a int, r int, g int, b int")


def chunks(files: DataFrame, column: str = "content") -> DataFrame:
    """files with idx, name, size, data of every chunk instead of the column; files that are no RIFF files have none."""
    from ..codecs import riff

    small_batches(files)
    names, schema = _schema(files, {column, "idx", "name", "size", "data"}, "idx int, name string, size long, data binary")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            take, out = [], []
            for k, data in enumerate(b.column(column).to_pylist()):
                try:
                    own = riff.chunks(data or b"")
                except ValueError:
                    continue
                for i, (name, payload) in enumerate(own):
                    take.append(k)
                    out.append((i, name.decode("latin-1"), len(payload), payload))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int32(), pa.string(), pa.int64(), pa.binary()))]
            kept = b.take(pa.array(take, pa.int64()))
            yield pa.record_batch([*(kept.column(n) for n in names), *columns], [*names, "idx", "name", "size", "data"])

    return files.mapInArrow(run, schema)


def metadata(chunk_rows: DataFrame, key: str) -> DataFrame:
    """key, icc, exif, xmp: of several chunks of a kind the last."""
    of = lambda name: F.max_by(F.when(F.col("name") == name, F.col("data")), F.when(F.col("name") == name, F.col("idx")))
    return chunk_rows.groupBy(key).agg(of("ICCP").alias("icc"), of("EXIF").alias("exif"), of("XMP ").alias("xmp"))

