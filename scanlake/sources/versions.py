"""Datasets that are replaced as a whole: each version lies in a folder of its own, and one small file says which one counts.

A version is written beside the others. The file that names it is renamed into place last, in one step, so readers see the old version or the new
one, complete; what a failed writer left behind is never named. All of it goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CURRENT = "current.json"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def store_of(spark: SparkSession, path: str):
    """The Hadoop file system that holds path."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file scans show it, with its scheme."""
    return store_of(spark, path).makeQualified(_path(spark, path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return store_of(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    store_of(spark, path).delete(_path(spark, path), True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it into place, over an earlier one."""
    jvm, fs, draft = spark.sparkContext._jvm, store_of(spark, path), f"{path}.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, draft), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(_path(spark, draft)), fs.makeQualified(_path(spark, path)), over)


def current(spark: SparkSession, root: str) -> dict | None:
    """What was told of the version that counts, with its folder as `version`; None where none was ever finished."""
    path = f"{root}/{CURRENT}"
    if not exists(spark, path):
        return None
    stream = store_of(spark, path).open(_path(spark, path))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, write: Callable[[str], dict | None]) -> dict:
    """Call write(folder) for a new folder in root; once it returns, that version counts, with the small facts that it returned.

    The version before it stays for those that still read it; earlier ones are deleted. If write raises, nothing changes.
    """
    before, version = current(spark, root), f"v-{uuid.uuid4().hex}"
    told = {**(write(f"{root}/{version}") or {}), "version": version}
    put_text(spark, f"{root}/{CURRENT}", json.dumps(told))
    kept = {version, before and before["version"]}
    for found in store_of(spark, root).listStatus(_path(spark, root)):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in kept:
            delete(spark, f"{root}/{name}")
    return told


def load(spark: SparkSession, root: str, part: str = "") -> DataFrame:
    """The table (or a named part) of the version that counts."""
    told = current(spark, root)
    if told is None:
        raise ValueError(f"no finished dataset in {root}")
    return spark.read.parquet("/".join(filter(None, (root, told["version"], part))))
