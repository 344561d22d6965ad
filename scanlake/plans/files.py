"""Queries that write files derived from the tables and read them again, and scans of the table files themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import labels, names
from scanlake.operators import chunks
from scanlake.plans.images import as_images
from scanlake.plans.names import INDEX_SQL, index_columns, with_f1
from scanlake.registry import query, table
from scanlake.sources import images as S
from scanlake.sources import tables as T
from scanlake.sources.headers import image_headers
from scanlake.sources.work import new_folder


def png_folder(spark, sf_dir):
    """A folder in the shared place with a PNG file for each row of embeddings."""
    path = new_folder(spark, "png")
    S.write_files(S.encoded(as_images(spark, sf_dir)), path)
    return path


def image_path():
    """The path of a scanned file as the table of images has it."""
    return F.concat(F.lit("/images/"), names.basename(F.col("path"))).alias("path")


@query("select concat('/images/', lpad(cast(vec_id as string), 9, '0'), '.png') as path, true as has_bytes from embeddings")
def scan_image_files(spark, sf_dir):
    """The image files of a folder, by suffix, in order of their path; contents stay unread."""
    found = S.scan_files(spark, png_folder(spark, sf_dir), names.FINALIZE_EXTENSIONS)
    return found.select(image_path(), (F.col("length") > 0).alias("has_bytes")).orderBy("path")


@query(
    f"with {X.F5}, {X.GRAY} select concat('/images/', lpad(cast(vec_id as string), 9, '0'), '.png') as path, 8 as width, 8 as height, 1 as channels, 'uint8' as dtype, sum(v)::bigint as total, sum(v*(y*8+x+1))::bigint as place from gray group by vec_id"
)
def scan_image_decoded(spark, sf_dir):
    """PNG files made of the embeddings, read from their folder and decoded; checksums of their pixels. A file that is no image raises."""
    out = S.decoded_images(spark, png_folder(spark, sf_dir)).withColumn("path", image_path())
    rows = out.select("path", "width", "height", "channels", "dtype", F.posexplode("data").alias("p", "v"))
    return rows.groupBy("path", "width", "height", "channels", "dtype").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("p") + 1)).alias("place"))


@query("select concat('/images/', lpad(cast(vec_id as string), 9, '0'), '.png') as path, 8 as width, 8 as height, 1 as channels, 'uint8' as dtype from embeddings")
def image_attributes(spark, sf_dir):
    """Size, channels and depth of image files in a folder, from their first bytes."""
    return image_headers(spark, png_folder(spark, sf_dir)).select(image_path(), "width", "height", "channels", "dtype")


@query(with_f1("select filename, toxic as has_contraband from f1 join labels using (doc_id)"))
def scan_metadata_csv(spark, sf_dir):
    path = new_folder(spark, "metadata")
    rows = X.files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("has_contraband")), "doc_id")
    T.write_index(rows, path, "filename", "has_contraband")
    return T.metadata_csv(spark, path)


@query(f"with {X.F1}, {X.F3} select concat('images/', true_split, '/', filename) as filepath, true_split as split, cast(doc_id as string) as doc_id from f3")
def scan_index_csv(spark, sf_dir):
    path = new_folder(spark, "index")
    rows = X.index(spark, sf_dir).withColumn("filepath", F.concat_ws("/", F.lit("images"), "true_split", "filename"))
    T.write_index(rows, path, "filepath", F.col("true_split").alias("split"), F.col("doc_id").cast("string").alias("doc_id"))
    return T.index_csv(spark, path)


@query(
    f"with {X.F1}, {X.F2} select image, case when coalesce(empty,0)=1 then 1 else 0 end as class_id from f2 where pos%2=0 union all select image, isolated_items as class_id from f2 where pos%2=1"
)
def scan_label_json(spark, sf_dir):
    """Label files of both shapes, a document each for 50 rows: lists of flags, and objects of path to class."""
    path, rows = new_folder(spark, "labels"), X.flags(spark, sf_dir).withColumn("doc", F.floor(F.col("pos") / 50))
    listed = rows.filter("pos % 2 = 0").groupBy("doc").agg(F.to_json(F.collect_list(F.struct("image", "no_contraband", "isolated_items", "empty"))).alias("value"))
    key = F.concat(F.lit("images\\train\\"), F.col("image"))
    mapped = rows.filter("pos % 2 = 1").groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "isolated_items")))).alias("value"))
    # One document a file, many files a task.
    listed.select("value").union(mapped.select("value")).write.option("maxRecordsPerFile", 1).text(path)
    return T.label_json(spark, path, labels.rule_empty)


@query(f"with {X.F1}, {X.F2} select image, no_contraband, isolated_items, empty from f2")
def scan_label_list(spark, sf_dir):
    """Label files as tools write them, indented arrays of 500 rows at most, read with one schema."""
    path = new_folder(spark, "labels")
    rows = X.flags(spark, sf_dir).groupBy(F.floor(F.col("pos") / 500)).agg(F.collect_list(F.struct("image", "no_contraband", "isolated_items", "empty")).alias("rows"))
    T.write_documents(rows, path, F.col("rows"))
    return T.label_list(spark, path).select("image", "no_contraband", "isolated_items", "empty")


@query("select user_id as image_id, count(*) as n_annotations, max(event_id) as last_annotation from events where user_id in (select doc_id from documents) group by user_id")
def scan_coco(spark, sf_dir):
    """Detection documents (one for each 1000 annotations) as three relations; annotations per image."""
    from scanlake.operators.annotations import coco_relations
    from scanlake.plans.annotations import coco

    images, annotations, _ = coco(spark, sf_dir)
    rows = annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").withColumn("doc", F.floor(F.col("id") / 1000))
    documents = rows.groupBy("doc").agg(
        F.array_distinct(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name"))).alias("images"),
        F.array_distinct(F.collect_list(F.struct(F.col("category_id").alias("id"), F.col("category_id").cast("string").alias("name")))).alias("categories"),
        F.collect_list(F.struct("id", "image_id", "category_id")).alias("annotations"),
    )
    path = new_folder(spark, "coco")
    T.write_documents(documents, path, F.struct("images", "categories", "annotations"))
    found, _, marks = coco_relations(T.coco_documents(spark, path))
    rows = marks.join(found.select(F.col("id").alias("image_id")), "image_id")
    return rows.groupBy("image_id").agg(F.count("*").alias("n_annotations"), F.max("id").alias("last_annotation"))


@query("select count(distinct source) as n_labels, count(*) as n_samples from documents")
def manifest_counts(spark, sf_dir):
    """Labels and samples named in a manifest; written in parts, so that no list holds them all."""
    path = new_folder(spark, "manifest")
    rows = table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / 500))
    parts = rows.groupBy("part").agg(F.collect_set("source").alias("labels"), F.collect_list(F.col("doc_id").cast("string")).alias("samples"))
    T.write_documents(parts, path, F.struct("labels", "samples"))
    read = T.manifest(spark, path)
    labels = read.select(F.explode("labels").alias("l")).agg(F.countDistinct("l").alias("n_labels"))
    return labels.crossJoin(read.agg(F.sum(F.size("samples")).alias("n_samples")))


@query("select v.filename, v.has_contraband, (select count(*) from labels l where l.toxic = v.has_contraband) as n from (values ('sample1.png', 0), ('sample2.png', 1), ('sample3.png', 0)) v(filename, has_contraband)")
def literal_rows(spark, sf_dir):
    """Rows written down in code, with how many labels agree with them."""
    given = spark.createDataFrame([("sample1.png", 0), ("sample2.png", 1), ("sample3.png", 0)], "filename string, has_contraband int")
    counts = table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("has_contraband")).agg(F.count("*").alias("n"))
    return given.join(counts, "has_contraband", "left").select("filename", "has_contraband", F.coalesce("n", F.lit(0)).alias("n"))


WRITTEN_INDEX = ("filepath", "split", "stage", "scan_session_id", "group_id", "filename", "scan_timestamp", "source_path")


@query(with_f1(f"select filepath, split, stage, scan_session_id, group_id, filename, scan_timestamp, source_path from ({INDEX_SQL}) t"))
def write_index(spark, sf_dir):
    """The index as CSV with a header, read again as text."""
    path = new_folder(spark, "index")
    T.write_index(X.files(spark, sf_dir).select(*index_columns(F.expr(X.SPLIT))), path, *WRITTEN_INDEX)
    return T.index_csv(spark, path).select(*WRITTEN_INDEX)


#: The layout of the last stage: no tag and no group, and the source under another name.
WITHOUT_GROUP = ("filepath", "split", "stage", "scan_session_id", "filename", "scan_timestamp")


@query(with_f1(f"select filepath, split, stage, scan_session_id, filename, scan_timestamp, source_path as source_interim_path from ({INDEX_SQL}) t"))
def write_index_without_group(spark, sf_dir):
    path = new_folder(spark, "index")
    T.write_index(X.files(spark, sf_dir).select(*index_columns(F.expr(X.SPLIT))), path, *WITHOUT_GROUP, F.col("source_path").alias("source_interim_path"))
    return T.index_csv(spark, path)


WITH_ATTRIBUTES = ("filepath", "split", "dataset_tag", "stage", "scan_session_id", "source_path", "width", "height", "channels", "dtype")


@query(
    f"""with p as (select *, concat(lpad(cast(vec_id as string), 9, '0'), '.png') as name, {X.SPLIT.replace("doc_id", "vec_id")} as split from embeddings)
 select concat('images/', split, '/', name) as filepath, split, 'tag' as dataset_tag, 'Stage0' as stage, 'images' as scan_session_id, concat('images/', name) as source_path, '8' as width, '8' as height, '1' as channels, 'uint8' as dtype from p"""
)
def write_index_with_attributes(spark, sf_dir):
    """The layout of the command line tool: size, channels and depth of each file, from its header."""
    files = image_headers(spark, png_folder(spark, sf_dir))
    name = names.basename(F.col("path"))
    rows = files.select(name.alias("name"), "width", "height", "channels", "dtype").withColumn("doc_id", F.regexp_extract("name", "^([0-9]+)", 1).cast("long"))
    rows = rows.select("*", F.expr(X.SPLIT).alias("split"), F.lit("tag").alias("dataset_tag"), F.lit("Stage0").alias("stage"), F.lit("images").alias("scan_session_id"))
    rows = rows.withColumns({"filepath": names.join_path(F.lit("images"), F.col("split"), F.col("name")), "source_path": names.join_path(F.lit("images"), F.col("name"))})
    path = new_folder(spark, "index")
    T.write_index(rows, path, *WITH_ATTRIBUTES)
    return T.index_csv(spark, path)


@query(with_f1("select filename as image, 1 as no_contraband, 0 as isolated_items, 1 as empty from f1 where lower(filename) like '%.png'"))
def write_labels(spark, sf_dir):
    """Stamped labels of a folder as JSON lines, sorted by name, read again."""
    path = new_folder(spark, "labels")
    rows = X.files(spark, sf_dir).filter(names.has_extension(F.col("path"), names.LABEL_EXTENSIONS))
    rows.select(F.col("filename").alias("image"), F.lit(1).alias("no_contraband"), F.lit(0).alias("isolated_items"), F.lit(1).alias("empty")).sort("image").write.json(path)
    return T.label_list(spark, path, lines=True).select("image", "no_contraband", "isolated_items", "empty")


def media(spark, sf_dir):
    """Texts stand for image bytes: doc_id, name, split, dataset_tag, content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.expr(X.SPLIT).alias("split"))
    return rows.join(X.files(spark, sf_dir).select("doc_id", F.col("filename").alias("name")), "doc_id").withColumn("dataset_tag", F.lit("tag"))


MEDIA_SQL = f"select split, count(*) as n_files, sum(strlen(text))::bigint as n_bytes from (select {X.SPLIT} as split, text from documents) t"


@query(MEDIA_SQL + " group by split")
def write_images_by_split(spark, sf_dir):
    """Contents partitioned by tag and split; files and bytes per split as read again."""
    path = new_folder(spark, "media")
    media(spark, sf_dir).write.partitionBy("dataset_tag", "split").parquet(path)
    read = spark.read.parquet(path)
    return read.groupBy("split").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query("select source, count(*) as n from documents group by source")
def save_or_load_dataset(spark, sf_dir):
    """Built once, then loaded: the second builder is not used."""
    path = new_folder(spark, "dataset")
    T.save_or_load(spark, path, lambda: table(spark, sf_dir, "documents").select("doc_id", "source"))
    return T.save_or_load(spark, path, lambda: table(spark, sf_dir, "labels")).groupBy("source").agg(F.count("*").alias("n"))


@query("select lang, count(*) as n from documents group by lang")
def save_or_load_table(spark, sf_dir):
    """The same as a table of the catalog."""
    name = f"dataset_{uuid.uuid4().hex}"
    T.save_or_load_table(spark, name, lambda: table(spark, sf_dir, "documents").select("doc_id", "lang"))
    return T.save_or_load_table(spark, name, lambda: table(spark, sf_dir, "labels")).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"select split, count(*) as n_files from (select {X.SPLIT} as split, doc_id from documents) t where split = 'train' or (split = 'val' and doc_id%20 = 0) group by split")
def rebuild_dataset(spark, sf_dir):
    """Building a dataset again empties every split first: val shrinks, and test, which has no rows any more, goes."""
    path = new_folder(spark, "dataset")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(X.SPLIT).alias("split"))
    T.rebuild(rows, path, "split")
    return T.rebuild(rows.filter("split = 'train' or (split = 'val' and doc_id % 20 = 0)"), path, "split").groupBy("split").agg(F.count("*").alias("n_files"))


@query(
    """select d.doc_id, case when l.toxic is null then '' else case when l.toxic=1 then 'contraband' else 'no_contraband' end end as labels, coalesce(a.n, 0) as n_detections
 from documents d left join labels l using (doc_id) left join (select user_id as doc_id, count(*) as n from events group by user_id) a using (doc_id)"""
)
def export_dataset(spark, sf_dir):
    """Merged samples with nested labels and detections, as read again."""
    from scanlake.plans.annotations import coco

    _, annotations, _ = coco(spark, sf_dir)
    marks = annotations.groupBy(F.col("image_id").alias("doc_id")).agg(F.collect_list(F.struct("category_id", F.array("x", "y", "w", "h").alias("bbox"))).alias("det"))
    known = table(spark, sf_dir, "labels").select("doc_id", F.array(F.struct(labels.binary_name(F.col("toxic")).alias("label"))).alias("cls"))
    samples = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").join(marks, "doc_id", "left")
    path = new_folder(spark, "export")
    samples.write.parquet(path)
    read = spark.read.parquet(path)
    listed = F.array_join(F.transform("cls", lambda c: c["label"]), "|")
    return read.select("doc_id", F.coalesce(listed, F.lit("")).alias("labels"), F.coalesce(F.size("det"), F.lit(0)).cast("long").alias("n_detections"))


@query(
    """select count(*) as n_samples, count(l.toxic) as n_labelled, sum(coalesce(a.n, 0))::bigint as n_detections, sum(strlen(d.text))::bigint as n_bytes, 'tag' as dataset_tag
 from documents d left join labels l using (doc_id) left join (select user_id as doc_id, count(*) as n from events group by user_id) a using (doc_id)"""
)
def export_manifest(spark, sf_dir):
    """An export with media beside the samples, and its manifest of one row, worked out from what was written."""
    from scanlake.plans.annotations import coco

    _, annotations, _ = coco(spark, sf_dir)
    marks = annotations.groupBy(F.col("image_id").alias("doc_id")).agg(F.collect_list("category_id").alias("det"))
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("cls"))
    path = new_folder(spark, "export")
    media(spark, sf_dir).select("doc_id", "name", "content").write.parquet(f"{path}/media")
    table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").join(marks, "doc_id", "left").write.parquet(f"{path}/samples")
    samples, contents = spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/media")
    counts = samples.agg(F.count("*").alias("n_samples"), F.count("cls").alias("n_labelled"), F.sum(F.coalesce(F.size("det"), F.lit(0))).cast("long").alias("n_detections"))
    counts.crossJoin(contents.agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))).withColumn("dataset_tag", F.lit("tag")).write.json(f"{path}/manifest")
    return T.read_json(spark, f"{path}/manifest", "n_samples long, n_labelled long, n_detections long, n_bytes long, dataset_tag string", lines=True)


@query(f"select count(*) as n_files, sum(strlen(text))::bigint as n_bytes, {X.digest_sql('text')} as digest from documents")
def dataset_fingerprint(spark, sf_dir):
    """Files, bytes and a digest that no order changes: two sums over the files' whole hashes, so no list of them is gathered."""
    text = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_files"), F.sum(F.octet_length(text)).cast("long").alias("n_bytes"), X.digest(text).alias("digest"))


TREE = """leaf as (select {side}, substr(md5(path), 1, 2) as node, count(*) as n, md5(string_agg(concat(path, ':', md5(text)), ',' order by path)) as digest from f group by {side}, substr(md5(path), 1, 2)),
 mid as (select {side}, substr(node, 1, 1) as node, sum(n)::bigint as n, md5(string_agg(concat(node, ':', digest), ',' order by node)) as digest from leaf group by {side}, substr(node, 1, 1)),
 top as (select {side}, '' as node, sum(n)::bigint as n, md5(string_agg(concat(node, ':', digest), ',' order by node)) as digest from mid group by {side}),
 tree as (select 2 as level, * from leaf union all select 1, * from mid union all select 0, * from top)"""


def hashed(rows):
    """path and digest of rows(doc_id, text)."""
    return rows.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"with f as (select 0 as side, concat('docs/', cast(doc_id as string), '.txt') as path, text from documents), {TREE.format(side='side')} select level, node, n, digest from tree")
def dataset_hash_tree(spark, sf_dir):
    """Digests of a dataset, of sixteenths of it, and of sixteenths of these, by the hash of the files' paths."""
    return chunks.hash_tree(hashed(table(spark, sf_dir, "documents")), digits=2)


@query(
    f"""with f as (select 0 as side, concat('docs/', cast(doc_id as string), '.txt') as path, text from documents union all
 select 1, concat('docs/', cast(doc_id as string), '.txt'), case when doc_id%97=5 then concat(text, '.') else text end from documents where doc_id%151<>7), {TREE.format(side='side')},
 a as (select * from tree where side=0), b as (select * from tree where side=1)
 select coalesce(a.level, b.level) as level, coalesce(a.node, b.node) as node, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b on a.level=b.level and a.node=b.node where a.digest is distinct from b.digest"""
)
def dataset_differences(spark, sf_dir):
    """Where two versions of a dataset differ: some texts are changed in the second, and some are not in it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = rows.filter("doc_id % 151 <> 7").withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return chunks.tree_differences(*(chunks.hash_tree(hashed(r), digits=2) for r in (rows, changed)))


@query(
    f"""with {X.F5}, {X.GRAY}, r as (select vec_id, cast(floor(y/2.0) as int) as y, cast(floor(x/2.0) as int) as x, cast(floor(avg(v)+0.5) as int) as v from gray group by 1, 2, 3), o as (select unnest([-1,0,1]) as d),
 n as (select g.vec_id, g.y, g.x, m.v from r g cross join o a cross join o b join r m on m.vec_id=g.vec_id and m.y=least(greatest(g.y+a.d,0),3) and m.x=least(greatest(g.x+b.d,0),3)),
 m as (select vec_id, y, x, cast(median(v) as int) as v from n group by vec_id, y, x)
 select concat('interim/images/', lpad(cast(vec_id as string), 9, '0'), '.png') as path, 4 as height, 4 as width, 'uint8' as dtype, sum(v)::bigint as total, sum(v*(y*4+x+1))::bigint as place from m group by vec_id"""
)
def preprocess_folder(spark, sf_dir):
    """The job from folder to folder: read images, transform them, write each under its relative path; then what was written, read again."""
    out = f"{new_folder(spark, 'preprocessed')}/interim"
    S.preprocess_folder(spark, png_folder(spark, sf_dir), out, (4, 4))
    read = S.decoded_images(spark, out).withColumn("path", F.regexp_extract("path", "(interim/.*)$", 1))
    rows = read.select("path", "height", "width", "dtype", F.posexplode("data").alias("p", "v"))
    return rows.groupBy("path", "height", "width", "dtype").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("p") + 1)).alias("place"))
