"""Annotation tasks and detection documents as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nested form of a task file; value stays text, for its shape depends on the kind of result.
RESULT = "struct<type string, value string, confidence double>"
TASK = f"data struct<image string>, annotations array<struct<result array<{RESULT}>>>"


def choice_labels(value: Column) -> Column:
    """Labels of a result's value, by kind `type`: an array, empty where there are none."""
    return F.coalesce(F.from_json(F.get_json_object(value, "$.choices"), "array<string>"), F.array())


def single_choice(value: Column) -> Column:
    found = F.get_json_object(value, "$.choice")
    return F.when(F.coalesce(found, F.lit("")) == "", F.array()).otherwise(F.array(found))


def taxonomy_label(value: Column) -> Column:
    """From a list of paths the last part of the first path, from a single path its last part, else nothing."""
    tree = F.try_variant_get(F.try_parse_json(value), "$.taxonomy", "variant")
    first = F.schema_of_variant(F.try_variant_get(tree, "$[0]", "variant"))
    nested = F.try_element_at(F.try_variant_get(tree, "$[0]", "array<string>"), F.lit(-1))
    plain = F.try_element_at(F.try_variant_get(tree, "$", "array<string>"), F.lit(-1))
    found = F.when(first.startswith("ARRAY"), nested).when(first == "STRING", plain)
    return F.when(F.coalesce(found, F.lit("")) == "", F.array()).otherwise(F.array(found))


def result_labels(tasks: DataFrame) -> DataFrame:
    """task, a, r, i (places of annotation, result and item), label, confidence; from rows (task, annotations)."""
    rows = tasks.select("task", F.posexplode("annotations").alias("a", "ann")).select("task", "a", F.posexplode("ann.result").alias("r", "res"))
    value, kind = F.col("res.value"), F.col("res.type")
    labels = F.when(kind == "choices", choice_labels(value)).when(kind == "choice", single_choice(value)).when(kind == "taxonomy", taxonomy_label(value))
    return rows.select("task", "a", "r", F.col("res.confidence").alias("confidence"), F.posexplode(labels).alias("i", "label"))


def ordered_distinct(rows: DataFrame) -> DataFrame:
    """task, label, first (place), confidence: labels in the order of their first sighting, with the confidence they had there."""
    place = F.struct("a", "r", "i")
    return rows.groupBy("task", "label").agg(F.min(place).alias("first"), F.min_by("confidence", place).alias("confidence"))


def coco_relations(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, categories and annotations of detection documents; of equal ids the last wins, by document, then by place.

    A column `document` tells the order of documents; without it there must be one document only, or this raises.
    """
    if "document" not in documents.columns:
        if documents.limit(2).count() > 1:
            raise ValueError("several detection documents need a column `document` that tells their order")
        documents = documents.withColumn("document", F.lit(0))
    part = lambda c: documents.select("document", F.posexplode(c).alias("pos", "r")).select("document", "pos", "r.*")
    order = F.struct("document", "pos")
    last = lambda t: t.groupBy("id").agg(F.max_by(F.struct(*[c for c in t.columns if c not in ("id", "document", "pos")]), order).alias("_r")).select("id", "_r.*")
    return last(part("images")), last(part("categories")), part("annotations").drop("document")
