"""Datasets that are replaced as a whole: what a failure leaves behind, and stages that are added to frozen ones."""

import json

import pytest
from pyspark.sql import functions as F

from scanlake.operators import datasets as D
from scanlake.sources import tables as T
from scanlake.sources import versions as V


def broken(df):
    """df, whose job fails after it has begun to write."""
    return df.repartition(2).withColumn("v", F.when(F.col("v") == 1, F.raise_error(F.lit("lost an executor"))).otherwise(F.col("v")))


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r.v for r in df.collect())


def test_a_failed_version_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "data")
    with pytest.raises(ValueError, match="no finished dataset"):
        V.load(spark, root)
    V.publish(spark, root, lambda folder: table(spark, 5, 6).write.parquet(folder) or {"note": "é"})
    with pytest.raises(Exception, match="lost an executor"):
        V.publish(spark, root, lambda folder: broken(table(spark, 1, 2, 3)).write.parquet(folder))
    assert values(V.load(spark, root)) == [5, 6] and V.current(spark, root)["note"] == "é"

    def half(folder):
        table(spark, 7).write.parquet(folder)
        raise RuntimeError("between two writes")

    old = V.load(spark, root)
    with pytest.raises(RuntimeError):
        V.publish(spark, root, half)
    assert values(V.load(spark, root)) == [5, 6]
    V.publish(spark, root, lambda folder: table(spark, 8).write.parquet(folder))
    assert values(V.load(spark, root)) == [8] and values(old) == [5, 6]
    left = [p.name for p in (tmp_path / "data").iterdir() if p.name.startswith("v-")]
    assert len(left) == 2 and json.loads((tmp_path / "data" / "current.json").read_text())["version"] in left


def test_save_or_load(spark, tmp_path):
    path = str(tmp_path / "saved")
    with pytest.raises(Exception, match="lost an executor"):
        T.save_or_load(spark, path, lambda: broken(table(spark, 1, 2)))
    assert values(T.save_or_load(spark, path, lambda: table(spark, 3))) == [3]
    assert values(T.save_or_load(spark, path, lambda: table(spark, 4))) == [3]
    assert values(T.save_or_load(spark, path, lambda: table(spark, 4), overwrite=True)) == [4]
    (tmp_path / "half" / "v-1").mkdir(parents=True)
    assert values(T.save_or_load(spark, str(tmp_path / "half"), lambda: table(spark, 9))) == [9]


def test_save_or_load_table(spark):
    with pytest.raises(Exception, match="lost an executor"):
        T.save_or_load_table(spark, "kept_rows", lambda: broken(table(spark, 1, 2)))
    assert not spark.catalog.tableExists("kept_rows")
    assert values(T.save_or_load_table(spark, "kept_rows", lambda: table(spark, 3))) == [3]
    with pytest.raises(Exception, match="lost an executor"):
        T.save_or_load_table(spark, "kept_rows", lambda: broken(table(spark, 1, 2)), overwrite=True)
    assert values(T.save_or_load_table(spark, "kept_rows", lambda: table(spark, 4))) == [3]
    assert values(T.save_or_load_table(spark, "kept_rows", lambda: table(spark, 4), overwrite=True)) == [4] == values(spark.table("kept_rows"))
    other = T.save_or_load_table(spark, "kept_rows", lambda: table(spark, 5).withColumn("w", F.lit("x")), overwrite=True)
    assert [tuple(r) for r in other.collect()] == [(5, "x")]
    spark.sql("drop table kept_rows")


def test_rebuild_replaces_all_folders(spark, tmp_path):
    path = str(tmp_path / "rebuilt")
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "v int, split string")
    T.rebuild(rows, path, "split")
    with pytest.raises(Exception, match="lost an executor"):
        T.rebuild(broken(rows), path, "split")
    assert values(V.load(spark, path)) == [1, 2, 3]
    assert values(T.rebuild(rows.filter("split <> 'test'"), path, "split")) == [1, 2]


def test_a_stage_is_added_to_a_frozen_one(spark, tmp_path):
    """Three rows: one stays, one collides, one is added and stamped."""
    root = str(tmp_path / "frozen")
    files = lambda *rows: spark.createDataFrame(rows, "split string, filename string")
    D.freeze(D.index_rows(files(("train", "a_aug01.png"), ("val", "b.png")), "Stage1", "s7", "/interim/Stage1"), root, "Stage1")
    added = files(("train", "a_aug01.png"), ("train", "2026-01-21_10-32-05-130_orig.png"), ("test", "b.png"))
    for _ in range(2):
        told = D.append_stage(spark, root, added, "/processed/Stage0")
        assert told["counts"] == {"train": 2, "val": 1, "test": 1} and told["sources"] == ["Stage1", "/processed/Stage0"]
        assert sorted(map(tuple, V.load(spark, root, "index").collect())) == [
            ("images/test/b.png", "test", "Stage01_combined", "merged_stage0_stage1", "b", "b.png", "", "/processed/Stage0/test/b.png"),
            ("images/train/2026-01-21_10-32-05-130_orig.png", "train", "Stage01_combined", "merged_stage0_stage1", "2026-01-21_10-32-05-130", "2026-01-21_10-32-05-130_orig.png", "2026-01-21T10:32:05.130", "/processed/Stage0/train/2026-01-21_10-32-05-130_orig.png"),
            ("images/train/a_aug01.png", "train", "Stage1", "s7", "a", "a_aug01.png", "", "/interim/Stage1/train/a_aug01.png"),
            ("images/val/b.png", "val", "Stage1", "s7", "b", "b.png", "", "/interim/Stage1/val/b.png"),
        ]
    bad = added.withColumn("filename", F.when(F.col("split") == "test", F.raise_error(F.lit("lost an executor"))).otherwise(F.concat(F.lit("new"), "filename")))
    with pytest.raises(Exception, match="lost an executor"):
        D.append_stage(spark, root, bad, "another")
    assert V.current(spark, root) == told and V.load(spark, root, "index").count() == 4
