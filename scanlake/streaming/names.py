"""Index rows of a stream of new files. The functions are stateless, so a stream needs no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import names


def new_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = names.FINALIZE_EXTENSIONS) -> DataFrame:
    """A streaming DataFrame (path, length) of image files as they appear below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "length").filter(names.has_extension(F.col("path"), extensions))


def indexed(files: DataFrame, split: Column) -> DataFrame:
    """path, filename, group_id, stage, scan_timestamp and split; works on batches and streams alike."""
    name = names.basename(F.col("path"))
    return files.select("path", name.alias("filename"), names.group_id(name).alias("group_id"), names.stage(F.col("path")).alias("stage"), names.scan_timestamp(name).alias("scan_timestamp"), split.alias("split"))
