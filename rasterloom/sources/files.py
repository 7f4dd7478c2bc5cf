"""Reading and writing picture files.

read_images goes through Spark's binaryFile source, so it reads from any store Spark reads. write_images writes one file for each row with a Python data source
writer whose tasks write under temporary names and whose commit renames them, so a lost executor leaves no half file. The data source
`rasterloom` (register it once) offers both by format name, for paths that all executors see as files.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.bytes import image_config
from ..operators import images

FORMAT = "rasterloom"


def read_files(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """path, length, content of files under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_configs(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """path, codec, width, height, alpha: from headers alone, in built-in expressions."""
    return read_files(spark, path, pattern).select("path", *[v.alias(k) for k, v in image_config(F.col("content")).items()])


def read_images(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """path, width, height, rgba, error."""
    return images.decode(read_files(spark, path, pattern).select("path", "content"))


def write_images(pictures: DataFrame, path: str, lossy: bool = False, quality: float = 0.0) -> None:
    """Writes pictures (name, width, height, rgba) as path/name.webp."""
    pictures.sparkSession.dataSource.register(PictureFiles)
    pictures.select("name", "width", "height", "rgba").write.format(FORMAT).mode("append").options(lossy=str(lossy).lower(), quality=str(quality)).save(path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class PictureFiles(DataSource):
    """Options: path; lossy, quality (when writing); files (names in one task when reading, 64)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, width int, height int, rgba binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.many = options["path"].removeprefix("file://"), int(options.get("files", 64))

    def partitions(self) -> list[_Files]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.webp"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_Files(found[i : i + self.many]) for i in range(0, len(found), self.many)] or [_Files([])]

    def read(self, partition: _Files):
        from ..codecs import image

        for path in partition.paths:
            name = os.path.splitext(os.path.basename(path))[0]
            with open(path, "rb") as f:
                data = f.read()
            try:
                p = image.decode(data)
                yield name, p.shape[1], p.shape[0], p.astype(np.uint8).tobytes(), None
            except ValueError as e:
                yield name, None, None, None, str(e)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.lossy, self.quality = options["path"].removeprefix("file://"), options.get("lossy", "false") == "true", float(options.get("quality", 0))

    def write(self, rows) -> _Written:
        from ..codecs import image

        os.makedirs(self.path, exist_ok=True)
        done = []
        for r in rows:
            data = image.encode(np.frombuffer(bytes(r.rgba), np.uint8).reshape(r.height, r.width, 4), self.lossy, self.quality)
            final = os.path.join(self.path, f"{os.path.basename(str(r.name))}.webp")
            held = f"{final}.{uuid.uuid4().hex}.part"
            with open(held, "wb") as f:
                f.write(data)
            done.append((held, final))
        return _Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for held, final in m.names if m else ():
                os.replace(held, final)

    def abort(self, messages) -> None:
        for m in messages:
            for held, _ in m.names if m else ():
                if os.path.exists(held):
                    os.remove(held)
