"""Folders of container files as a stream of pixels or headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec


def blob_stream(spark: SparkSession, path: str, suffix: str = ".grid", files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder as (raster_id, blob)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = files.option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_per_trigger).load(path)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return read.select(name.alias("raster_id"), F.col("content").alias("blob"))


def pixel_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Pixels of each new file; files that can't be read are left out."""
    return codec.decode_pixels(blob_stream(spark, path), strict=False, **options)


def header_stream(spark: SparkSession, path: str) -> DataFrame:
    return codec.blob_info(blob_stream(spark, path), strict=False)
