"""Frozen datasets of labelled images: an index of files, and a manifest with their counts and sources, that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import names
from scanlake.sources import versions

INDEX = ("filepath", "split", "stage", "scan_session_id", "group_id", "filename", "scan_timestamp", "source_interim_path")
#: What rows that were added to a frozen stage are stamped with.
COMBINED = ("Stage01_combined", "merged_stage0_stage1")


def index_rows(files: DataFrame, stage: str, session: str, source: str) -> DataFrame:
    """The index of files(split, filename) that lie in a folder for each split of `source`."""
    name = F.col("filename")
    columns = {
        "filepath": names.join_path(F.lit("images"), F.col("split"), name),
        "stage": F.lit(stage),
        "scan_session_id": F.lit(session),
        "group_id": names.group_id(name),
        "scan_timestamp": names.scan_timestamp(name),
        "source_interim_path": names.join_path(F.lit(source), F.col("split"), name),
    }
    return files.select("split", "filename").withColumns(columns).select(*INDEX)


def _freeze(spark: SparkSession, root: str, index: DataFrame, sources: list[str]) -> dict:
    def write(folder: str) -> dict:
        index.write.parquet(f"{folder}/index")
        counts = spark.read.parquet(f"{folder}/index").groupBy("split").count().collect()
        return {"counts": dict(map(tuple, counts)), "sources": sources}

    return versions.publish(spark, root, write)


def freeze(index: DataFrame, root: str, source: str) -> dict:
    """A new version of the dataset in root with these index rows; its manifest: counts of each split, and sources."""
    return _freeze(index.sparkSession, root, index, [source])


def append_stage(spark: SparkSession, root: str, files: DataFrame, source: str) -> dict:
    """Add files(split, filename) of another stage to the dataset in root; returns the new manifest.

    Rows of the index stay as they are. A file whose name its split has already is left out, and so is one whose path the index has; the others are stamped
    as combined. Index, counts and sources change in one step or not at all; adding the same files again changes nothing.
    """
    told, index = versions.current(spark, root), versions.load(spark, root, "index")
    fresh = files.dropDuplicates(["split", "filename"]).join(index.select("split", "filename"), ["split", "filename"], "left_anti")
    rows = index_rows(fresh, *COMBINED, source).join(index.select("filepath"), "filepath", "left_anti").select(*INDEX)
    return _freeze(spark, root, index.unionByName(rows), told["sources"] + [s for s in [source] if s not in told["sources"]])
