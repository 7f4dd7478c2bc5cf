"""Picture files as a stream: new files of a folder are described and decoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import image_config
from ..operators import images

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.webp", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_configs(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, modificationTime, codec, width, height, alpha, from headers alone."""
    return stream_files(spark, path, **options).select("path", "modificationTime", *[v.alias(k) for k, v in image_config(F.col("content")).items()])


def stream_images(spark: SparkSession, path: str, **options) -> DataFrame:
    return images.decode(stream_files(spark, path, **options).select("path", "modificationTime", "content"))


def sizes_by_window(configs: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """How many pictures of each codec, and of how many pixels, came in each window of modification time; late files up to the watermark."""
    rows = configs.withWatermark("modificationTime", late)
    return rows.groupBy(F.window("modificationTime", window).alias("window"), "codec").agg(F.count("*").alias("n"), F.sum(F.col("width") * F.col("height")).alias("pixels"))
