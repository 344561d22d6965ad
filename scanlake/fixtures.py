"""Inputs in the shape of image folders, labels and annotations, derived from the given tables; and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.registry import table

FILE_NAME = """concat('2026-01-21_', lpad(cast(cast(floor(g/3600) as int)%24 as string),2,'0'), '-', lpad(cast(cast(floor(g/60) as int)%60 as string),2,'0'), '-',
 lpad(cast(g%60 as string),2,'0'), '-', lpad(cast(g%1000 as string),3,'0'),
 case when doc_id%5=4 then '_orig' when g%4=0 then concat('_aug',lpad(cast(doc_id%5 as string),3,'0')) else concat('_aug',lpad(cast(doc_id%5 as string),2,'0')) end,
 case when doc_id%11=0 then '.PNG' when doc_id%13=0 then '.txt' else '.png' end)"""
FILE_PATH = "concat('/data/interim/Stage',cast(g%3 as string),'/session_',lpad(cast(g%7 as string),3,'0'),'/',filename)"
GROUP = "cast(floor(doc_id/5) as int)"
ROOT = "/data/interim"

SPLIT = "case when doc_id%10=0 then 'val' when doc_id%20=1 then 'test' else 'train' end"

F1 = f"f1 as (select *, {FILE_PATH} as path from (select *, {FILE_NAME} as filename from (select doc_id, {GROUP} as g from documents) t0) t1)"
F2 = """f2 as (select f.filename as image, 1 as no_contraband, coalesce(l.quality,0) as isolated_items,
 case when f.doc_id%17=0 then 1 else 1-coalesce(l.quality,0) end as empty, f.doc_id as pos from f1 f join labels l on l.doc_id = f.doc_id)"""
F3 = f"""f3 as (select doc_id, filename, {SPLIT} as true_split,
 case when doc_id%19=0 then '' when doc_id%23=0 then concat(' ',upper({SPLIT}),' ') else {SPLIT} end as split,
 case when doc_id%29=0 then concat('images',chr(92),{SPLIT},chr(92),filename) else concat('images/',{SPLIT},'/',filename) end as filepath from f1)"""
F4 = "f4 as (select vec_id, cast(embedding[1] as double) as z0, cast(embedding[2] as double) as z1, label%2 as y from embeddings)"
#: Ten logits and a class of ten.
F4_TEN = "ten as (select vec_id, label as y, list_transform(embedding[1:10], lambda x: cast(x as double)) as z from embeddings)"
F5 = "px as (select vec_id, cast(floor(p/8.0) as int) as y, cast(p%8 as int) as x, p, cast(v as double) as v from (select vec_id, unnest(range(64)) as p, unnest(embedding) as v from embeddings) t)"
GRAY = "gray as (select vec_id, y, x, 0 as c, cast(floor((v+1)*127.5) as int) as v from px)"
COLOR = """color as (select a.vec_id, a.y, a.x, cast(c.c as int) as c, cast(floor((b.v+1)*127.5) as int) as v
 from px a cross join (select unnest(range(3)) as c) c join px b on b.vec_id=a.vec_id and b.p=(a.p+16*c.c)%64)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, g, filename, path; five siblings a group."""
    rows = table(spark, sf_dir, "documents").select("doc_id").withColumn("g", F.expr(GROUP))
    return rows.withColumn("filename", F.expr(FILE_NAME)).withColumn("path", F.expr(FILE_PATH))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, no_contraband, isolated_items, empty, pos."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = files(spark, sf_dir).join(labels, "doc_id")
    quality = F.coalesce("quality", F.lit(0))
    empty = F.when(F.col("doc_id") % 17 == 0, 1).otherwise(1 - quality)
    return rows.select(F.col("filename").alias("image"), F.lit(1).alias("no_contraband"), quality.alias("isolated_items"), empty.alias("empty"), F.col("doc_id").alias("pos"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, true_split, split, filepath; splits can be blank or padded, paths can have backslashes."""
    rows = files(spark, sf_dir).withColumn("true_split", F.expr(SPLIT))
    own = F.col("true_split")
    split = F.when(F.col("doc_id") % 19 == 0, "").when(F.col("doc_id") % 23 == 0, F.concat(F.lit(" "), F.upper(own), F.lit(" "))).otherwise(own)
    slash = F.when(F.col("doc_id") % 29 == 0, "\\").otherwise("/")
    return rows.select("doc_id", "filename", "true_split", split.alias("split"), F.concat(F.lit("images"), slash, own, slash, F.col("filename")).alias("filepath"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, z0, z1, y."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", e[0].cast("double").alias("z0"), e[1].cast("double").alias("z1"), (F.col("label") % 2).alias("y"))


def ten_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, z: ten logits and a class of ten."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y"), F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("z"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, p, y, x, v: the 64 components as an 8 x 8 grid."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    return rows.select("vec_id", "p", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), "v")


def pixels(spark: SparkSession, sf_dir: str, color: bool = False, levels: float = 127.5) -> DataFrame:
    """vec_id, y, x, c, v; channel c of a color image takes component (p + 16 c) mod 64."""
    value = F.floor((F.col("v") + 1) * levels).cast("int").alias("v")
    rows = components(spark, sf_dir)
    if not color:
        return rows.select("vec_id", "y", "x", F.lit(0).alias("c"), value)
    to = F.transform(F.array(*[F.lit(c) for c in range(3)]), lambda c: F.struct(c.alias("c"), ((F.col("p") - 16 * c + 64) % 64).alias("q")))
    rows = rows.select("vec_id", "v", F.explode(to).alias("to"))
    return rows.select("vec_id", F.floor(F.col("to.q") / 8).cast("int").alias("y"), (F.col("to.q") % 8).alias("x"), F.col("to.c").alias("c"), value)


def digest(content) -> Column:
    """An aggregate of contents that no order changes: the sums of both 60-bit ends of their md5, as text."""
    ends = [F.conv(F.substring(F.md5(content), at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 18)]
    return F.concat_ws("-", *[F.sum(e).cast("string") for e in ends])


def digest_sql(content: str) -> str:
    return "concat(" + ", '-', ".join(f"cast(sum(('0x' || substr(md5({content}), {at}, 15))::bigint) as varchar)" for at in (1, 18)) + ")"
