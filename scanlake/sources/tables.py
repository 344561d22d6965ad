"""Readers of metadata, indexes, labels, tasks and manifests, with explicit schemas; and the writers that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import labels, names
from scanlake.operators.annotations import TASK
from scanlake.sources import versions
from scanlake.sources.work import new_folder

#: One nullable schema for all stages' label lists.
LABEL_LIST = "image string, no_contraband int, isolated_items int, overlapping_items int, empty int"


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, has_contraband (int); a missing file or column raises."""
    df = require(spark.read.csv(path, header=True), "filename", "has_contraband")
    return df.select("filename", F.col("has_contraband").cast("int").alias("has_contraband"))


def index_csv(spark: SparkSession, path: str) -> DataFrame:
    """An index, every column text; raises without rows or without filepath."""
    return require_rows(require(spark.read.csv(path, header=True), "filepath"), "index rows")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents (one value or array a file, indented or not), or one value a line; what does not parse raises when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(not lines).lower()).json(path)


def label_list(spark: SparkSession, path: str, missing: str = "raise", lines: bool = False) -> DataFrame:
    """A label list, as a JSON array or as lines. missing: "raise", or "empty" for no rows where the file is absent."""
    try:
        return read_json(spark, path, LABEL_LIST, lines)
    except Exception as error:
        if missing == "empty" and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], LABEL_LIST)
        raise


def _parsed(schema: str):
    """The JSON text in `value` by schema; raises with the file's path where it does not parse."""
    return F.coalesce(F.from_json("value", schema), F.raise_error(F.concat(F.lit("broken labels in "), F.col("file"))))


def label_json(spark: SparkSession, path: str, rule, on_bad: str = "raise") -> DataFrame:
    """image, class_id from JSON texts that are lists of label rows (by rule) or objects of path to class (by base name).

    A text that is neither, or does not parse, raises with its path. on_bad: what happens to rows whose flags contradict each other (the rule
    gives no class): "raise", or "keep" for rows with a null class, to be set aside by labels.consistent.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    other = F.raise_error(F.concat(F.lit("labels must be a JSON list or object: "), F.col("file")))
    text = text.withColumn("value", F.when(F.col("value").rlike(r"^[\[{]"), F.col("value")).otherwise(other))
    rows = f"array<struct<{LABEL_LIST.replace(' ', ':').replace(',:', ',')}>>"
    listed = text.filter(F.col("value").startswith("[")).select(F.explode(_parsed(rows)).alias("r")).select("r.*")
    mapped = text.filter(F.col("value").startswith("{")).select(F.explode(_parsed("map<string,int>")).alias("path", "class_id"))
    classed = labels.consistent(listed, rule, on_bad)[0]
    return classed.select("image", "class_id").unionByName(mapped.select(names.basename(names.normalized(F.col("path"))).alias("image"), "class_id"))


def annotation_tasks(spark: SparkSession, path: str, more: str = "", lines: bool = False) -> DataFrame:
    """Tasks with an image, from export documents or lines; value of a result stays JSON text."""
    schema = ", ".join(filter(None, (more, TASK)))
    return read_json(spark, path, schema, lines).filter("data.image is not null")


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_json(spark, path, "labels array<string>, samples array<string>", lines)


COCO = "images array<struct<id long, file_name string>>, categories array<struct<id int, name string>>, annotations array<struct<id long, image_id long, category_id int>>"


def coco_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Detection documents, with `document`, which sorts them by file, then by place in it."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return read_json(spark, path, COCO, lines).withColumn("document", place)


def write_documents(df: DataFrame, path: str, value: Column) -> None:
    """A file for each row of df, holding the indented JSON of value."""
    text = df.select(F.to_json(value, {"pretty": "true"}).alias("value"))
    text.write.option("maxRecordsPerFile", 1).text(path)


def write_index(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def save_or_load(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """The stored dataset, or build() stored: built where none was ever finished, or if overwrite. What a failed attempt left behind does not count."""
    if overwrite or versions.current(spark, path) is None:
        versions.publish(spark, path, lambda folder: build().write.parquet(folder))
    return versions.load(spark, path)


def save_or_load_table(spark: SparkSession, name: str, build, overwrite: bool = False) -> DataFrame:
    """The same for a table of the catalog. Its rows are written to a new folder first; then the catalog is told where they are.

    A table that is replaced by rows of the same columns changes its place in one step; other columns make a new table.
    """
    if overwrite or not spark.catalog.tableExists(name):
        folder = new_folder(spark, name)
        build().write.parquet(folder)
        rows = spark.read.parquet(folder)
        if spark.catalog.tableExists(name) and spark.table(name).schema == rows.schema:
            spark.sql(f"alter table {name} set location '{folder}'")
            spark.catalog.refreshTable(name)
        else:
            spark.sql(f"drop table if exists {name}")
            spark.catalog.createTable(name, path=folder, source="parquet")
    return spark.table(name)


def rebuild(df: DataFrame, path: str, *folders: str) -> DataFrame:
    """Write df in folders as the new version of a dataset, which is read again; folders that df has no rows for are not in it.

    The version before counts until the new one is complete, and can still be read by those that began with it.
    """
    versions.publish(df.sparkSession, path, lambda folder: df.write.partitionBy(*folders).parquet(folder))
    return versions.load(df.sparkSession, path)
