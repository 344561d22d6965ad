"""Labels and boxes of annotation exports as nested columns of a table of samples, under names that the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions import labels as L
from scanlake.functions import names
from scanlake.operators import annotations as A
from scanlake.operators import chunks, merges

#: Boxes of a sample in one row; a sample with more has several rows.
SIZE = 4096


def _with_field(samples: DataFrame, field: str, *taken: str) -> DataFrame:
    """samples with the column `_new` as `field`; where that is null, what a column of that name held before stays."""
    if field in taken:
        raise ValueError(f"the field {field} would hide a column that is needed")
    new = F.coalesce("_new", field) if field in samples.columns else F.col("_new")
    return samples.withColumn(field, new).drop("_new")


def with_classifications(samples: DataFrame, tasks: DataFrame, folder: str, field: str = "cls_gt") -> tuple[DataFrame, DataFrame]:
    """samples(path, ...) with `field`, an array of (label, confidence), and the outcome of each task: (task, path, outcome).

    tasks: (task: a number of its own that tells the order, data, annotations). A task belongs to the file of its image's cleaned name in `folder`, else
    to the last path with that base name; outcomes are labelled, missing (no such file) or no_label. Labels come in the order of their first
    sighting. Of several tasks of one file the last with labels counts; files without labels keep what `field` held, or have null.
    A path of several rows is labelled in all of them.
    """
    name = names.basename(F.col("path"))
    direct = F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), name)
    by_name = samples.select(name.alias("_name"), F.struct(direct.alias("direct"), "path").alias("_at")).groupBy("_name").agg(F.max("_at").alias("_at"))
    first = A.ordered_distinct(A.result_labels(tasks)).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("first", "label", "confidence"))).alias("found"))
    first = first.select("task", F.transform("found", lambda s: F.struct(s["label"].alias("label"), s["confidence"].alias("confidence"))).alias("_new"))
    wanted = tasks.select("task", names.clean_annotation_name(F.col("data.image")).alias("_name")).join(by_name, "_name", "left").join(first, "task", "left")
    outcome = F.when(F.col("_at").isNull(), "missing").when(F.col("_new").isNull(), "no_label").otherwise("labelled")
    imported = wanted.select("task", F.col("_at.path").alias("path"), outcome.alias("outcome"), "_new")
    of_path = merges.last_wins(imported.filter("outcome = 'labelled'").select("path", "task", "_new"), ["path"], "task").drop("task")
    return _with_field(samples.join(of_path, "path", "left"), field, "path"), imported.drop("_new")


def with_detections(
    samples: DataFrame, images: DataFrame, annotations: DataFrame, categories: DataFrame, field: str = "det_gt", size: int = SIZE, order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """samples(path, ...) with `field`, an array of (label, bounding_box: shares of width and height), chunk and outcome.

    images(id, file_name, width, height), annotations(image_id, category_id, x, y, w, h and the columns of `order`) and categories(id, name) have unique ids.
    A sample has the boxes of the image with its base name, the name being cleaned; of equal names the image with the largest id. A category
    without a name is shown by its number. outcome: merged, empty (an image without boxes) or missing (no image); the last two keep what `field` held, or have
    null. A sample with more than `size` boxes has several rows, chunk 0 on, so none holds all of a hot image. A width or height of 0 raises.
    """
    renamed = images.select(names.clean_annotation_name(F.col("file_name")).alias("_name"), F.col("id").alias("image_id"), "width", "height")
    by_name = merges.last_wins(renamed, ["_name"], "image_id")
    rows = annotations.join(by_name.drop("_name"), "image_id").join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("_label")), "category_id", "left")
    box = L.box_normalized(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    shown = F.struct(F.coalesce("_label", F.col("category_id").cast("string")).alias("label"), box.alias("bounding_box"))
    rows = rows.select("image_id", *order, shown.alias("box"))
    lists = chunks.chunked(rows, "image_id", list(order), F.col("box"), size).select(F.col("image_id").alias("_image"), F.col("chunk").alias("_chunk"), F.col("found").alias("_new"))
    placed = samples.withColumn("_name", names.basename(F.col("path"))).join(by_name.select("_name", F.col("image_id").alias("_id")), "_name", "left")
    placed = placed.join(lists, F.col("_id") == F.col("_image"), "left")
    outcome = F.when(F.col("_id").isNull(), "missing").when(F.col("_new").isNull(), "empty").otherwise("merged")
    placed = placed.withColumns({"outcome": outcome, "chunk": F.coalesce("_chunk", F.lit(0).cast("long"))}).drop("_name", "_id", "_image", "_chunk")
    return _with_field(placed, field, "path", "chunk", "outcome")
