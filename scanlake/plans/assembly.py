"""Queries on joins, merges and unions of indexes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import names
from scanlake.operators import datasets, merges, ranks
from scanlake.plans.names import DOT, GROUP_SQL, TIME_SQL
from scanlake.plans.splitting import RATIOS, cut_sql
from scanlake.registry import query, table
from scanlake.sources import versions
from scanlake.sources.work import new_folder

STAGE1, STAGE0 = "doc_id % 3 <> 0", "doc_id % 2 = 0"


@query("select d.doc_id, coalesce(l.toxic, 0) as label from documents d left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l using (doc_id)")
def join_labels_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return merges.with_labels(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id")


@query(
    f"""with {X.F1}, img as (select doc_id as image_id, path from f1 where doc_id%7 <> 0), nm as (select split_part(path, '/', -1) as name, max(image_id) as by_name from img group by 1),
 t as (select doc_id as task, case when doc_id%2=0 then path else concat('/elsewhere/', filename) end as p, filename as name from f1)
 select t.task, coalesce(img.image_id, nm.by_name) as image_id from t left join img on img.path=t.p left join nm on nm.name=t.name"""
)
def join_tasks_to_images(spark, sf_dir):
    """Tasks find their image by path, else by base name."""
    rows = X.files(spark, sf_dir)
    images = rows.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("image_id"), F.col("path").alias("filepath"))
    tasks = rows.select(F.col("doc_id").alias("task"), F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/elsewhere/"), F.col("filename"))).alias("p"), "filename")
    return merges.matched(tasks, images, F.col("p"), F.col("filename")).select("task", "image_id")


@query("select c.c_custkey, coalesce(n.n_name, cast(c.c_nationkey + 3 as string)) as category from customer c left join nation n on n.n_nationkey = c.c_nationkey + 3")
def join_category_names(spark, sf_dir):
    """Names by id; ids without a name are shown as text."""
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"), "n_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("category_id"))
    return rows.join(categories, "category_id", "left").select("c_custkey", F.coalesce("n_name", F.col("category_id").cast("string")).alias("category"))


@query("select doc_id, toxic from labels where doc_id in (select doc_id from documents where doc_id%3 <> 0)")
def semi_existing_files(spark, sf_dir):
    there = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(there, "doc_id", "left_semi")


@query("select doc_id, toxic from labels where doc_id not in (select doc_id from documents where doc_id%3 <> 0)")
def anti_missing_files(spark, sf_dir):
    there = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(there, "doc_id", "left_anti")


def two_indexes(spark, sf_dir):
    rows = X.index(spark, sf_dir).select("doc_id", F.col("true_split").alias("split"), "filename")
    return rows.filter(STAGE1).withColumn("stage", F.lit("Stage1")), rows.filter(STAGE0).withColumn("stage", F.lit("Stage0"))


TWO = f"""{X.F1}, {X.F3}, s1 as (select doc_id, true_split as split, filename, 'Stage1' as stage from f3 where {STAGE1}), s0 as (select doc_id, true_split as split, filename, 'Stage0' as stage from f3 where {STAGE0})"""


@query(
    f"""with {TWO} select doc_id, split, filename, stage, false as skipped from s1 union all
 select doc_id, split, filename, stage, exists (select 1 from s1 where s1.split=s0.split and s1.filename=s0.filename) from s0"""
)
def merge_skip_collisions(spark, sf_dir):
    """Stage 1 with the Stage 0 files it lacks; those it has are reported as skipped."""
    merged, skipped = merges.merge_skipping(*two_indexes(spark, sf_dir), ["split", "filename"])
    return merged.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True))).select("doc_id", "split", "filename", "stage", "skipped")


@query(f"with {TWO} select concat('images/', split, '/', filename) as filepath, stage from s1 union all select concat('images/', split, '/', filename), 'Stage01_combined' from s0 where doc_id not in (select doc_id from s1)")
def append_new_index_rows(spark, sf_dir):
    """Rows whose path is new, stamped with the combined stage."""
    path = F.concat_ws("/", F.lit("images"), "split", "filename").alias("filepath")
    old, new = (t.select(path, "stage") for t in two_indexes(spark, sf_dir))
    merged, _ = merges.merge_skipping(old, new.withColumn("stage", F.lit("Stage01_combined")), ["filepath"])
    return merged


@query(f"with {X.F1}, {X.F2} select image, no_contraband, 1 as isolated_items, 0 as empty, pos, 0 as source from f2 union all select image, no_contraband, isolated_items, empty, pos, 1 from f2")
def union_labels(spark, sf_dir):
    """Stage 1 labels, then Stage 0 labels, duplicates kept, with the order as a column."""
    rows = X.flags(spark, sf_dir)
    return merges.union_in_order(rows.withColumns({"isolated_items": F.lit(1), "empty": F.lit(0)}), rows)


@query(
    """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) t where r = 1"""
)
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return merges.last_wins(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select toxic as class_id, count(*) as n from labels group by toxic")
def class_distribution(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("class_id")).agg(F.count("*").alias("n"))


@query("select source, case when list_contains(langs, 'stage0') then langs else list_append(langs, 'stage0') end::varchar as sources from (select source, list_sort(list(distinct lang)) as langs from documents group by source) t")
def union_sources(spark, sf_dir):
    """A list of sources with one more, if it is not in it; shown as text."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    listed = F.array_union("langs", F.array(F.lit("stage0")))
    return rows.select("source", F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("sources"))


def appended(spark, sf_dir):
    """The folder of a frozen Stage 1 that Stage 0 was added to."""
    stage1, stage0 = (t.select("split", "filename") for t in two_indexes(spark, sf_dir))
    root = new_folder(spark, "frozen")
    datasets.freeze(datasets.index_rows(stage1, "Stage1", "session", "/interim/Stage1"), root, "Stage1")
    datasets.append_stage(spark, root, stage0, "/processed/Stage0")
    return root


APPENDED = f"""with {TWO}, m as (select split, filename, 'Stage1' as stage, 'session' as origin, '/interim/Stage1' as source from s1 union all
 select split, filename, 'Stage01_combined', 'merged_stage0_stage1', '/processed/Stage0' from s0 where not exists (select 1 from s1 where s1.split=s0.split and s1.filename=s0.filename))"""


@query(
    f"""{APPENDED} select split, stage, origin, count(*) as n_files, sum(count(*)) over (partition by split)::bigint as n_split, 'Stage1|/processed/Stage0' as sources from m group by split, stage, origin"""
)
def merge_stages_append(spark, sf_dir):
    """Stage 0 added to a frozen Stage 1: its own rows stay as they are, added ones are stamped; counts and sources are those of the manifest."""
    root = appended(spark, sf_dir)
    told = versions.current(spark, root)
    counts = F.create_map(*[F.lit(v) for pair in told["counts"].items() for v in pair])
    rows = versions.load(spark, root, "index").groupBy("split", "stage", F.col("scan_session_id").alias("origin")).agg(F.count("*").alias("n_files"))
    return rows.withColumns({"n_split": counts[F.col("split")].cast("long"), "sources": F.lit("|".join(told["sources"]))})


@query(
    f"""{APPENDED} select concat('images/', split, '/', filename) as filepath, split, stage, origin as scan_session_id, regexp_replace({DOT}, '_(orig|aug[0-9]{{2}})$', '') as group_id, filename, {TIME_SQL} as scan_timestamp,
 concat(source, '/', split, '/', filename) as source_interim_path from m"""
)
def merge_stages_append_index(spark, sf_dir):
    """The index after adding, which is the manifest's lists of files as well."""
    return versions.load(spark, appended(spark, sf_dir), "index")


REBUILT = f"""with {X.F1}, {X.F3}, n as (select f1.doc_id, f1.filename, {GROUP_SQL.replace("filename", "f1.filename")} as group_id from f1 where {STAGE1}),
 g as (select group_id, row_number() over (order by md5(concat('42:', group_id)), group_id) as r, count(*) over () as n from (select distinct group_id from n) t),
 c as (select group_id, {cut_sql("g", "floor(n*0.85::double)", "floor(n*0.1::double)")}), s1 as (select n.doc_id, n.filename, c.split, 'Stage1' as stage from n join c using (group_id)),
 s0 as (select doc_id, filename, true_split as split, 'Stage0' as stage from f3 where {STAGE0}),
 m as (select * from s1 union all select * from s0 where not exists (select 1 from s1 where s1.split=s0.split and s1.filename=s0.filename))"""


def rebuilt(spark, sf_dir):
    """Stage 1 split by group and Stage 0 as it was split before, without what collides."""
    rows = X.index(spark, sf_dir)
    stage1 = rows.filter(STAGE1).select("doc_id", "filename", names.group_id(F.col("filename")).alias("group_id"))
    stage1 = ranks.split_groups(stage1, "group_id", RATIOS).select("doc_id", "filename", "split", F.lit("Stage1").alias("stage"))
    stage0 = rows.filter(STAGE0).select("doc_id", "filename", F.col("true_split").alias("split"), F.lit("Stage0").alias("stage"))
    return merges.merge_skipping(stage1, stage0, ["split", "filename"])[0]


@query(
    f"""{REBUILT}
 select split, stage, count(*) as n_files, min(filename) as first_file, max(filename) as last_file from m group by split, stage"""
)
def merge_stages_rebuild(spark, sf_dir):
    """Stage 1 split by group, Stage 0 as it was split before, collisions skipped, stages kept; then the manifest's counts."""
    merged = rebuilt(spark, sf_dir)
    return merged.groupBy("split", "stage").agg(F.count("*").alias("n_files"), F.min("filename").alias("first_file"), F.max("filename").alias("last_file"))


@query(f"{REBUILT} select concat('images/', split, '/', filename) as filepath, split, stage, filename, regexp_replace({DOT}, '_(orig|aug[0-9]{{2}})$', '') as group_id, {TIME_SQL} as scan_timestamp from m")
def merge_stages_index(spark, sf_dir):
    """The index rows of the merged stages."""
    name = F.col("filename")
    path = names.join_path(F.lit("images"), F.col("split"), name)
    return rebuilt(spark, sf_dir).select(path.alias("filepath"), "split", "stage", "filename", names.group_id(name).alias("group_id"), names.scan_timestamp(name).alias("scan_timestamp"))


@query(
    f"""{REBUILT} select split, count(*) as n_files, count(distinct case when stage='Stage1' then regexp_replace({DOT}, '_(orig|aug[0-9]{{2}})$', '') end) as n_groups_stage1, {X.digest_sql("filename")} as files_digest,
 case split when 'train' then 0.85 when 'val' then 0.1 else 0.05 end::double as ratio_stage1, 42 as seed, 'base name' as grouping_stage1, 'Stage1|Stage0' as sources from m group by split"""
)
def merge_stages_manifest(spark, sf_dir):
    """The combined manifest, a row for each split; its file lists are rows of merge_stages_index."""
    group = F.when(F.col("stage") == "Stage1", names.group_id(F.col("filename")))
    out = rebuilt(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_files"), F.countDistinct(group).alias("n_groups_stage1"), X.digest(F.col("filename")).alias("files_digest"))
    ratio = F.when(F.col("split") == "train", RATIOS[0]).when(F.col("split") == "val", RATIOS[1]).otherwise(RATIOS[2])
    return out.withColumns({"ratio_stage1": ratio, "seed": F.lit(42), "grouping_stage1": F.lit("base name"), "sources": F.lit("Stage1|Stage0")})
