"""Joins and merges of indexes and labels; equi joins only, and every "last wins" has an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions import names


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the latest by order; partial aggregation, so a hot key is combined before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def with_labels(files: DataFrame, labels: DataFrame, key: str, default: int | None = 0) -> DataFrame:
    """files with `label` by key; labels(key, label) must have one row a key. default None leaves NULL."""
    joined = files.join(labels, key, "left")
    return joined if default is None else joined.withColumn("label", F.coalesce("label", F.lit(default)))


def in_split(index: DataFrame, split: str, empty: str = "raise") -> DataFrame:
    """Rows of a split: by its column, or where that is blank by the path; slashes are normalised.

    empty: "raise" where the split has no rows, or "allow".
    """
    own = names.normalized_split(F.col("split"))
    fixed = index.withColumn("filepath", names.normalized(F.col("filepath")))
    rows = fixed.filter((own == split) | ((own == "") & F.col("filepath").contains(f"images/{split}/")))
    if empty == "raise" and rows.isEmpty():
        raise ValueError(f"no rows in split {split}")
    return rows


def matched(df: DataFrame, images: DataFrame, path: Column, name: Column) -> DataFrame:
    """df with `image_id` of the image at a path, else of one with that base name; images(image_id, filepath) has distinct paths."""
    by_name = images.groupBy(names.basename(F.col("filepath")).alias("_name")).agg(F.max("image_id").alias("_by_name"))
    by_path = images.select(F.col("filepath").alias("_path"), F.col("image_id").alias("_by_path"))
    rows = df.withColumns({"_path": path, "_name": name}).join(by_path, "_path", "left").join(by_name, "_name", "left")
    return rows.withColumn("image_id", F.coalesce("_by_path", "_by_name")).drop("_path", "_name", "_by_path", "_by_name")


def merge_skipping(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(target with the source rows that do not collide, source rows that do)."""
    taken = target.select(*keys)
    return target.unionByName(source.join(taken, keys, "left_anti"), allowMissingColumns=True), source.join(taken, keys, "left_semi")


def union_in_order(*tables: DataFrame) -> DataFrame:
    """All rows, with `source`, the place of their table, so that later steps need no row order."""
    marked = [t.withColumn("source", F.lit(i)) for i, t in enumerate(tables)]
    out = marked[0]
    for t in marked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
