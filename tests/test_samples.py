import pytest
from pyspark.sql import functions as F

from scanlake.operators import samples as S

def tasks(spark, *rows):
    """(task, image, labels with confidences) as nested tasks."""
    flat = [(t, image, [("choice", f'{{"choice": "{label}"}}', c) for label, c in found]) for t, image, found in rows]
    df = spark.createDataFrame(flat, "task long, image string, result array<struct<type: string, value: string, confidence: double>>")
    return df.select("task", F.struct("image").alias("data"), F.array(F.struct("result")).alias("annotations"))


def found(df, field):
    return {r.path: None if r[field] is None else [tuple(x) for x in r[field]] for r in df.collect()}


def test_tasks_find_the_file_in_the_folder_first(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/z/a.png",), ("d/y/b.png",), ("d/z/b.png",), ("d/c.png",)], "path string")
    rows, outcomes = S.with_classifications(files, tasks(spark, (1, "/u/x1-a.png", [("p", 0.5), ("q", None), ("p", 0.9)]), (2, "x2-b.png", [("r", None)]), (3, "x-none.png", [("r", None)]), (4, "x-c.png", [])), "d/", "seen")
    assert found(rows, "seen") == {"d/a.png": [("p", 0.5), ("q", None)], "d/z/a.png": None, "d/y/b.png": None, "d/z/b.png": [("r", None)], "d/c.png": None}
    assert {tuple(r) for r in outcomes.collect()} == {(1, "d/a.png", "labelled"), (2, "d/z/b.png", "labelled"), (3, None, "missing"), (4, "d/c.png", "no_label")}


def test_the_last_task_with_labels_counts_and_old_values_stay(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/a.png",), ("d/b.png",)], "path string")
    rows, _ = S.with_classifications(files, tasks(spark, (1, "x-a.png", [("old", None)]), (2, "x-a.png", [("new", None)]), (3, "x-a.png", []), (4, "x-b.png", [("b", None)])), "d")
    assert rows.count() == 3 and found(rows, "cls_gt") == {"d/a.png": [("new", None)], "d/b.png": [("b", None)]}
    again, _ = S.with_classifications(rows, tasks(spark, (9, "x-a.png", [("newest", 0.1)])), "d")
    assert found(again, "cls_gt") == {"d/a.png": [("newest", 0.1)], "d/b.png": [("b", None)]}
    none, outcomes = S.with_classifications(rows.limit(0), tasks(spark, (9, "x-a.png", [("newest", 0.1)])), "d", "other")
    assert none.count() == 0 and [r.outcome for r in outcomes.collect()] == ["missing"]
    with pytest.raises(ValueError, match="path"):
        S.with_classifications(files, tasks(spark), "d", "path")


IMAGES = "id long, file_name string, width int, height int"
BOXES = "id long, image_id long, category_id int, x double, y double, w double, h double"


def test_boxes_of_samples(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/z/a.png",), ("d/b.png",), ("d/c.png",)], "path string")
    images = spark.createDataFrame([(1, "u/x-a.png", 10, 10), (2, "u/y-a.png", 100, 50), (3, "x-b.png", 10, 10), (4, "x-other.png", 0, 0)], IMAGES)
    boxes = spark.createDataFrame([(9, 2, 7, 50.0, 5.0, 10.0, 25.0), (8, 2, 5, 0.0, 0.0, 100.0, 50.0), (10, 2, 5, 1.0, 1.0, 1.0, 1.0), (1, 1, 5, 1.0, 1.0, 1.0, 1.0)], BOXES)
    categories = spark.createDataFrame([(5, "five")], "id int, name string")
    rows = S.with_detections(files, images, boxes, categories, "boxes", 2).collect()
    got = {(r.path, r.chunk): (r.outcome, r.boxes and [(b.label, b.bounding_box) for b in r.boxes]) for r in rows}
    two = [("five", [0.0, 0.0, 1.0, 1.0]), ("7", [0.5, 0.1, 0.1, 0.5])]
    third = [("five", [0.01, 0.02, 0.01, 0.02])]
    assert len(rows) == 6 and got == {
        **{(p, 0): ("merged", two) for p in ("d/a.png", "d/z/a.png")}, **{(p, 1): ("merged", third) for p in ("d/a.png", "d/z/a.png")},
        ("d/b.png", 0): ("empty", None), ("d/c.png", 0): ("missing", None),
    }
    kept = S.with_detections(files, images.filter("id = 3"), boxes, categories)
    assert {(r.outcome, r.det_gt is None) for r in kept.collect()} == {("empty", True), ("missing", True)}
    wrong = spark.createDataFrame([(1, 4, 5, 1.0, 1.0, 1.0, 1.0)], BOXES)
    with pytest.raises(Exception, match="(?i)zero"):
        S.with_detections(files, images, wrong, categories).collect()
    with pytest.raises(ValueError, match="chunk"):
        S.with_detections(files, images, boxes, categories, "chunk")
