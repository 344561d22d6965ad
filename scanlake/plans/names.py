"""Queries on file names, label rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import labels, names
from scanlake.operators.merges import in_split
from scanlake.registry import query, table

ROOT = X.ROOT
DOT = r"regexp_replace(filename, '[.][^.]*$', '')"
GROUP_SQL = rf"regexp_replace({DOT}, '_(orig|aug[0-9]{{2}})$', '')"
TIME_SQL = r"""case when regexp_matches(filename, '\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}-\d{3}') then
 concat(regexp_extract(filename, '(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})', 1), 'T', regexp_extract(filename, '(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})', 2), ':',
 regexp_extract(filename, '(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})', 3), ':', regexp_extract(filename, '(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})', 4), '.',
 regexp_extract(filename, '(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})', 5)) else '' end"""


def with_f1(select: str) -> str:
    return f"with {X.F1} {select}"


@query("select page_id, split_part(url, '/', -1) as name from pages")
def path_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.basename(F.col("url")).alias("name"))


@query(with_f1(f"select doc_id, {DOT} as stem, lower(regexp_extract(filename, '[.][^.]*$')) as suffix from f1"))
def path_stem_suffix(spark, sf_dir):
    name = F.col("filename")
    return X.files(spark, sf_dir).select("doc_id", names.stem(name).alias("stem"), names.suffix(name).alias("suffix"))


@query(with_f1("select doc_id, substr(path, length('/data/interim') + 2) as relpath from f1"))
def path_relative(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", names.relative(F.col("path"), ROOT).alias("relpath"))


@query(with_f1(r"select *, count(*) over (partition by target) > 1 as collides from (select doc_id, regexp_replace(path, '[.][^./]+$', '.png') as target from f1) t"))
def path_with_suffix(spark, sf_dir):
    """New paths, and whether several files would get the same."""
    rows = X.files(spark, sf_dir).select("doc_id", names.with_suffix(F.col("path"), ".png").alias("target"))
    counts = rows.groupBy("target").agg((F.count("*") > 1).alias("collides"))
    return rows.join(counts, "target").select("doc_id", "target", "collides")


@query(with_f1(f"select doc_id, concat('/data/raw/', filename) as source, concat('images/', {X.SPLIT}, '/', filename) as target from f1"))
def path_join(spark, sf_dir):
    name = F.col("filename")
    rows = X.index(spark, sf_dir)
    return rows.select("doc_id", names.join_path(F.lit("/data/raw"), name).alias("source"), names.join_path(F.lit("images"), F.col("true_split"), name).alias("target"))


@query(f"with {X.F1}, {X.F3} select doc_id, replace(filepath, chr(92), '/') as filepath from f3")
def normalize_separators(spark, sf_dir):
    return X.index(spark, sf_dir).select("doc_id", names.normalized(F.col("filepath")).alias("filepath"))


@query(f"with {X.F1}, {X.F3} select doc_id, lower(trim(coalesce(split, ''))) as split from f3")
def normalize_split(spark, sf_dir):
    return X.index(spark, sf_dir).select("doc_id", names.normalized_split(F.col("split")).alias("split"))


@query(with_f1("select doc_id, coalesce(list_filter(string_split(path, '/'), lambda p: starts_with(lower(p), 'stage'))[1], 'unknown') as stage from f1"))
def infer_stage(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", names.stage(F.col("path")).alias("stage"))


@query(with_f1("select doc_id, case when len(string_split(substr(path, 15), '/')) >= 2 then split_part(substr(path, 15), '/', 1) else 'unknown' end as scan_session_id from f1"))
def infer_session(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", names.session(F.col("path"), ROOT).alias("scan_session_id"))


@query(with_f1(f"select doc_id, {GROUP_SQL} as group_id, regexp_replace({DOT}, '_(orig|aug[0-9]+)$', '') as safe_group_id from f1"))
def group_id(spark, sf_dir):
    name = F.col("filename")
    return X.files(spark, sf_dir).select("doc_id", names.group_id(name).alias("group_id"), names.group_id(name, "any").alias("safe_group_id"))


@query(with_f1(f"select doc_id, {TIME_SQL} as scan_timestamp from f1"))
def scan_timestamp(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", names.scan_timestamp(F.col("filename")).alias("scan_timestamp"))


@query(with_f1("select doc_id, regexp_replace(concat('ab12cd-', filename), '^[^-]*-', '') as prefixed, regexp_replace(filename, '^[^-]*-', '') as unprefixed from f1"))
def clean_annotation_filename(spark, sf_dir):
    name = F.col("filename")
    given = F.concat(F.lit("/upload/ab12cd-"), name)
    return X.files(spark, sf_dir).select("doc_id", names.clean_annotation_name(given).alias("prefixed"), names.clean_annotation_name(name).alias("unprefixed"))


@query("select doc_id, case when toxic = 1 then 'contraband' else 'no_contraband' end as label from labels")
def binary_label_name(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", labels.binary_name(F.col("toxic")).alias("label"))


@query(f"with {X.F1}, {X.F2} select pos, case when coalesce(empty,0)=1 then 1 else 0 end as label from f2")
def class_rule_empty(spark, sf_dir):
    return X.flags(spark, sf_dir).select("pos", labels.rule_empty().alias("label"))


COMBO_SQL = "case when no_contraband=1 and isolated_items=0 and empty=1 then 0 when no_contraband=1 and isolated_items=1 and empty=0 then 1 end"


@query(f"with {X.F1}, {X.F2} select pos, {COMBO_SQL} as label from f2")
def class_rule_combo(spark, sf_dir):
    return X.flags(spark, sf_dir).select("pos", labels.rule_combo().alias("label"))


@query(f"with {X.F1}, {X.F2} select pos, case when isolated_items=1 then 0 else 1 end as label from f2")
def class_rule_contraband(spark, sf_dir):
    """The rule on a flag that varies in the given tables: quality stands for no_contraband."""
    rows = X.flags(spark, sf_dir).withColumn("no_contraband", F.col("isolated_items"))
    return rows.select("pos", labels.rule_contraband().alias("label"))


@query(with_f1("select filename as image, 1 as no_contraband, 1 as isolated_items, 0 as empty from f1 where lower(filename) like '%.png'"))
def auto_label(spark, sf_dir):
    rows = X.files(spark, sf_dir).filter(names.has_extension(F.col("path"), names.NOTEBOOK_EXTENSIONS))
    return rows.select(F.col("filename").alias("image"), F.lit(1).alias("no_contraband"), F.lit(1).alias("isolated_items"), F.lit(0).alias("empty"))


INDEX_SQL = f"""select doc_id, concat('images/', {X.SPLIT}, '/', filename) as filepath, {X.SPLIT} as split, 'tag' as dataset_tag,
 coalesce(list_filter(string_split(path, '/'), lambda p: starts_with(lower(p), 'stage'))[1], 'unknown') as stage,
 split_part(substr(path, 15), '/', 2) as scan_session_id, {GROUP_SQL} as group_id, filename, {TIME_SQL} as scan_timestamp, path as source_path from f1"""


def index_columns(split, stage_root=ROOT):
    """The index row of a path: every derived column in one projection."""
    path, name = F.col("path"), names.basename(F.col("path"))
    return [
        names.join_path(F.lit("images"), split, name).alias("filepath"), split.alias("split"), F.lit("tag").alias("dataset_tag"), names.stage(path).alias("stage"),
        F.element_at(F.split(names.relative(path, stage_root), "/"), 2).alias("scan_session_id"), names.group_id(name).alias("group_id"), name.alias("filename"),
        names.scan_timestamp(name).alias("scan_timestamp"), path.alias("source_path"),
    ]


@query(with_f1(INDEX_SQL))
def index_row(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", *index_columns(F.expr(X.SPLIT)))


@query(with_f1("select doc_id, filename from f1 where regexp_matches(lower(filename), '[.](png|jpg|jpeg|tif|tiff|bmp)$')"))
def filter_extension(spark, sf_dir):
    return X.files(spark, sf_dir).filter(names.has_extension(F.col("path"), names.FINALIZE_EXTENSIONS)).select("doc_id", "filename")


@query(
    f"""with {X.F1}, {X.F3} select doc_id, replace(filepath, chr(92), '/') as filepath from f3
 where lower(trim(split)) = 'val' or (trim(split) = '' and contains(replace(filepath, chr(92), '/'), 'images/val/'))"""
)
def filter_split(spark, sf_dir):
    return in_split(X.index(spark, sf_dir), "val").select("doc_id", "filepath")


@query(f"with {X.F1}, {X.F2} select image, pos, isolated_items, empty from f2 where {COMBO_SQL} is null")
def inconsistent_labels(spark, sf_dir):
    """Rows that break the combination rule, set aside."""
    return X.flags(spark, sf_dir).filter(labels.rule_combo().isNull()).select("image", "pos", "isolated_items", "empty")


@query("select source, bool_or(starts_with(lang, 'd')) as found from documents group by source")
def any_with_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.bool_or(F.col("lang").startswith("d")).alias("found"))
