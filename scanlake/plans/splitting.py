"""Queries on seeded order, splits and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import names
from scanlake.operators import chunks, ranks
from scanlake.plans.names import DOT, GROUP_SQL
from scanlake.registry import query, table

RATIOS = (0.85, 0.10, 0.05)
RANK = "row_number() over (order by md5(concat('42:', cast(doc_id as string))), doc_id)"


def cut_sql(rows: str, train: str, val: str) -> str:
    return f"case when r <= {train} then 'train' when r <= {train} + {val} then 'val' else 'test' end as split from {rows}"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id")


@query(f"select doc_id, {RANK} as rank from documents")
def stable_shuffle(spark, sf_dir):
    return ranks.seeded_rank(documents(spark, sf_dir), "doc_id").select("doc_id", "rank")


@query("select doc_id, " + cut_sql(f"(select doc_id, {RANK} as r, count(*) over () as n from documents) t", "round_even(n*0.8::double, 0)", "round_even(n*0.1::double, 0)"))
def split_images_rounded(spark, sf_dir):
    return ranks.split_rows(documents(spark, sf_dir), "doc_id", (0.8, 0.1, 0.1), "round").select("doc_id", "split")


@query("select doc_id, " + cut_sql(f"(select doc_id, {RANK} as r, count(*) over () as n from documents) t", "floor(n*0.85::double)", "floor(n*0.1::double)"))
def split_images_truncated(spark, sf_dir):
    return ranks.split_rows(documents(spark, sf_dir), "doc_id", RATIOS, "floor").select("doc_id", "split")


def groups_cte(group: str = GROUP_SQL) -> str:
    return f"""{X.F1}, named as (select *, {group} as group_id, regexp_replace({DOT}, '_(orig|aug[0-9]+)$', '') as true_group from f1),
 grouped as (select group_id, row_number() over (order by md5(concat('42:', group_id)), group_id) as r, count(*) over () as n from (select distinct group_id from named) t),
 cuts as (select group_id, {cut_sql("grouped", "floor(n*0.85::double)", "floor(n*0.1::double)")}), parts as (select named.*, cuts.split from named join cuts using (group_id))"""


def grouped(spark, sf_dir, digits="2"):
    """F1 split by group."""
    name = F.col("filename")
    rows = X.files(spark, sf_dir).withColumns({"group_id": names.group_id(name, digits), "true_group": names.group_id(name, "any")})
    return ranks.split_groups(rows, "group_id", RATIOS)


@query(f"with {groups_cte()} select doc_id, group_id, split from parts")
def split_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("doc_id", "group_id", "split")


@query(f"with {groups_cte()} select true_group, count(distinct split) as n_splits, count(*) as n_files from parts group by true_group having count(distinct split) > 1")
def leakage_report(spark, sf_dir):
    """Groups, by the stem without any number of digits, whose files are in several splits."""
    found = grouped(spark, sf_dir).groupBy("true_group").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n_files"))
    return found.filter("n_splits > 1")


@query(f"with {groups_cte()} select split, count(distinct group_id) as n_groups, count(*) as n_images from parts group by split")
def group_split_summary(spark, sf_dir):
    return grouped(spark, sf_dir).groupBy("split").agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_images"))


@query(f"with {groups_cte()} select group_id, count(*) as n_files, string_agg(filename, '|' order by filename) as files from parts group by group_id")
def group_members(spark, sf_dir):
    rows = X.files(spark, sf_dir).withColumn("group_id", names.group_id(F.col("filename")))
    return rows.groupBy("group_id").agg(F.count("*").alias("n_files"), F.array_join(F.sort_array(F.collect_list("filename")), "|").alias("files"))


@query(
    f"""with {groups_cte()}, c as (select group_id, filename, (row_number() over (partition by group_id order by filename, doc_id) - 1)//2 as chunk from parts)
 select group_id, chunk::bigint as chunk, count(*) as n, string_agg(filename, '|' order by filename) as files from c group by group_id, chunk"""
)
def group_member_chunks(spark, sf_dir):
    """The same in lists of two files at most, so that a group of any size is no single row."""
    rows = X.files(spark, sf_dir).withColumn("group_id", names.group_id(F.col("filename")))
    found = chunks.chunked(rows.select("group_id", "filename", "doc_id"), "group_id", ["filename", "doc_id"], F.col("filename"), 2)
    return found.select("group_id", "chunk", "n", F.array_join("found", "|").alias("files"))


@query(
    f"""with {groups_cte()}, l as (select doc_id, max(toxic) as label from labels group by doc_id)
 select split, count(*) as n_images, count(distinct group_id) as n_groups, sum(coalesce(label, 0))::bigint as n_positive, round(avg(coalesce(label, 0)), 6) as positive_rate from parts left join l using (doc_id) group by split"""
)
def split_label_summary(spark, sf_dir):
    """Names to groups, groups to splits, labels with a default, then images and positive rate per split."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = grouped(spark, sf_dir).join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_images"), F.countDistinct("group_id").alias("n_groups"), F.sum("label").alias("n_positive"), F.round(F.avg("label"), 6).alias("positive_rate")
    )


@query(f"select doc_id, case when r <= case when n > 1 then greatest(1, floor(0.2::double*n)) else 0 end then 'val' else 'train' end as split from (select doc_id, {RANK} as r, count(*) over () as n from documents) t")
def split_holdout(spark, sf_dir):
    return ranks.holdout(documents(spark, sf_dir), "doc_id", 0.2).select("doc_id", "split")


@query(f"select doc_id, cast(floor(({RANK}-1)/55.0) as bigint) as batch from documents")
def assign_minibatches(spark, sf_dir):
    return ranks.minibatches(documents(spark, sf_dir), "doc_id", 55).select("doc_id", "batch")


@query("select user_id, event_id, i from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events) t where i%10=0 or i=n")
def sample_every_nth_or_last(spark, sf_dir):
    """Every tenth row of a user, and the last one."""
    rows = ranks.ranked_within(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", F.date_trunc("day", "ts"), "ts", "event_id")
    return rows.filter("i % 10 = 0 or i = n").select("user_id", "event_id", "i")


@query("select doc_id, source, n_chars from documents order by doc_id limit 20")
def head_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy("doc_id").limit(20)


@query(f"with {X.F1} select doc_id, path from f1 order by path, doc_id")
def sort_paths(spark, sf_dir):
    return X.files(spark, sf_dir).select("doc_id", "path").orderBy("path", "doc_id")


@query(
    f"""with s as (select 'train' as split union all select 'val' union all select 'test'), f as (select {X.SPLIT} as split from documents where doc_id%20 <> 1)
 select s.split, count(f.split) as n_files from s left join f using (split) group by s.split"""
)
def split_counts(spark, sf_dir):
    """Files per split, 0 for a split without any."""
    rows = documents(spark, sf_dir).filter("doc_id % 20 <> 1").select(F.expr(X.SPLIT).alias("split"), F.lit(1).alias("one"))
    counts = rows.groupBy("split").agg(F.count("one").alias("n_files"))
    every = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    return every.join(counts, "split", "left").select("split", F.coalesce("n_files", F.lit(0)).alias("n_files"))


MANIFEST = f"""{X.F1}, ranked as (select doc_id, r, {cut_sql(f"(select doc_id, {RANK} as r, count(*) over () as n from documents) t", "round_even(n*0.8::double, 0)", "round_even(n*0.1::double, 0)")})"""


def manifest_rows(spark, sf_dir):
    """doc_id, rank, split, group_id: the lists of a split manifest, as rows."""
    rows = ranks.split_rows(documents(spark, sf_dir), "doc_id", (0.8, 0.1, 0.1), "round")
    return rows.join(X.files(spark, sf_dir).select("doc_id", names.group_id(F.col("filename")).alias("group_id")), "doc_id")


@query(
    f"""with {MANIFEST} select split, count(*) as n_files, count(distinct {GROUP_SQL}) as n_groups, min(doc_id) as first_doc, max(doc_id) as last_doc, {X.digest_sql("cast(doc_id as string)")} as files_digest,
 case split when 'train' then 0.8 else 0.1 end::double as ratio, 42 as seed, 'tag' as dataset_tag, 'by image' as grouping from ranked join f1 using (doc_id) group by split"""
)
def split_manifest(spark, sf_dir):
    """A row for each split: seed, tag, ratio, grouping, counts and a digest of its files, which are rows of split_manifest_files."""
    rows = manifest_rows(spark, sf_dir)
    out = rows.groupBy("split").agg(
        F.count("*").alias("n_files"), F.countDistinct("group_id").alias("n_groups"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), X.digest(F.col("doc_id").cast("string")).alias("files_digest")
    )
    ratio = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    return out.withColumns({"ratio": ratio, "seed": F.lit(42), "dataset_tag": F.lit("tag"), "grouping": F.lit("by image")})


@query(f"with {MANIFEST} select split, r as place, doc_id, {GROUP_SQL} as group_id from ranked join f1 using (doc_id)")
def split_manifest_files(spark, sf_dir):
    """The file lists of the manifest: split, place in the seeded order, file and group."""
    return manifest_rows(spark, sf_dir).select("split", F.col("rank").alias("place"), "doc_id", "group_id")
