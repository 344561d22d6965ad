"""Queries on annotation tasks, detection documents and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import labels as L
from scanlake.functions import names
from scanlake.operators import annotations as A
from scanlake.operators import chunks, merges, samples
from scanlake.registry import query, table
from scanlake.sources import tables as T
from scanlake.sources.work import new_folder

#: Kinds by turn: 0 choices with two labels, 1 a choice, 2 a nested taxonomy, 3 a plain taxonomy.
KIND = "turn % 4"
TASKS = """t as (select conv_id as task, turn, role, case when turn%4=0 then null else turn/10.0::double end as conf from conversations),
 r as (select task, turn as r, 0 as i, role as label, conf from t union all select task, turn, 1, 'extra', conf from t where turn%4=0)"""


def nested_tasks(spark, sf_dir):
    """Task documents: data.image and annotations, whose results have all four shapes, from conversations."""
    role = F.col("role")
    value = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.array(role, F.lit("extra")).alias("choices"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(role.alias("choice"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.array(F.array(F.lit("root"), role), F.array(F.lit("other"))).alias("taxonomy"))))
        .otherwise(F.to_json(F.struct(F.array(F.lit("root"), role).alias("taxonomy"))))
    )
    kind = F.when(F.col("turn") % 4 == 0, "choices").when(F.col("turn") % 4 == 1, "choice").otherwise("taxonomy")
    confidence = F.when(F.col("turn") % 4 == 0, F.lit(None)).otherwise(F.col("turn") / 10)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(kind.alias("type"), value.alias("value"), confidence.cast("double").alias("confidence")).alias("res"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("turn", "res"))), lambda x: x["res"])
    tasks = rows.groupBy(F.col("conv_id").alias("task")).agg(results.alias("result"))
    image = F.when(F.col("task") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("/upload/ab12cd-"), F.col("task").cast("string"), F.lit(".png")))
    return tasks.select("task", F.struct(image.alias("image")).alias("data"), F.array(F.struct("result")).alias("annotations"))


def written_tasks(spark, sf_dir):
    path = new_folder(spark, "tasks")
    tasks = nested_tasks(spark, sf_dir).groupBy(F.floor(F.col("task") / 100)).agg(F.collect_list(F.struct("task", "data", "annotations")).alias("tasks"))
    T.write_documents(tasks, path, F.col("tasks"))
    return T.annotation_tasks(spark, path, "task long")


@query("select conv_id as task, concat(cast(conv_id as string), '.png') as image, count(*) as n_results from conversations where conv_id%9 <> 0 group by conv_id")
def scan_annotation_tasks(spark, sf_dir):
    """Task files, read with an explicit schema; tasks without an image are left out."""
    rows = written_tasks(spark, sf_dir)
    return rows.select("task", names.clean_annotation_name(F.col("data.image")).alias("image"), F.size(F.col("annotations")[0]["result"]).cast("long").alias("n_results"))


@query(
    f"""with {TASKS}, o as (select task, label, r, i, conf, row_number() over (partition by task, label order by r, i) as k from r)
 select task, label, row_number() over (partition by task order by r, i) as place, conf as confidence from o where k=1 and task%9 <> 0"""
)
def ordered_distinct_labels(spark, sf_dir):
    """Labels of a task in the order they were first seen, with their first confidence, from nested task files."""
    found = A.ordered_distinct(A.result_labels(written_tasks(spark, sf_dir)))
    return found.select("task", "label", F.row_number().over(Window.partitionBy("task").orderBy("first")).cast("long").alias("place"), "confidence")


@query("select task, r, i, label from (select conv_id as task, turn as r, 0 as i, role as label from conversations where turn%4=0 union all select conv_id, turn, 1, 'extra' from conversations where turn%4=0) t where task%9 <> 0")
def choice_labels(spark, sf_dir):
    rows = written_tasks(spark, sf_dir).select("task", F.explode("annotations").alias("ann")).select("task", F.posexplode("ann.result").alias("r", "res")).filter("res.type = 'choices'")
    return rows.select("task", F.col("r").cast("long").alias("r"), F.posexplode(A.choice_labels(F.col("res.value"))).alias("i", "label"))


@query("select conv_id as task, turn as r, role as label from conversations where turn%4=1 and conv_id%9 <> 0")
def single_choice_label(spark, sf_dir):
    rows = written_tasks(spark, sf_dir).select("task", F.explode("annotations").alias("ann")).select("task", F.posexplode("ann.result").alias("r", "res")).filter("res.type = 'choice'")
    return rows.select("task", F.col("r").cast("long").alias("r"), F.explode(A.single_choice(F.col("res.value"))).alias("label"))


@query("select conv_id as task, turn as r, role as label from conversations where turn%4 in (2, 3) and conv_id%9 <> 0")
def taxonomy_label(spark, sf_dir):
    rows = written_tasks(spark, sf_dir).select("task", F.explode("annotations").alias("ann")).select("task", F.posexplode("ann.result").alias("r", "res")).filter("res.type = 'taxonomy'")
    return rows.select("task", F.col("r").cast("long").alias("r"), F.explode(A.taxonomy_label(F.col("res.value"))).alias("label"))


@query(
    """with t as (select conv_id as task, count(*) filter (role <> 'system') as n from conversations where conv_id%9 <> 0 group by conv_id)
 select count(*) filter (task%5 <> 0 and n > 0) as labelled, count(*) filter (task%5 = 0) as missing, count(*) filter (task%5 <> 0 and n = 0) as no_label from t"""
)
def label_import_counts(spark, sf_dir):
    """How many tasks were imported, had no image file, or had no label; every fifth image is missing."""
    rows = written_tasks(spark, sf_dir)
    labels = A.result_labels(rows).filter("label not in ('system', 'extra')").groupBy("task").agg(F.count("*").alias("n"))
    there, has = F.col("task") % 5 != 0, F.coalesce("n", F.lit(0)) > 0
    return rows.select("task").join(labels, "task", "left").agg(F.count_if(there & has).alias("labelled"), F.count_if(~there).alias("missing"), F.count_if(there & ~has).alias("no_label"))


def coco(spark, sf_dir):
    """images(id, file_name, width, height), annotations(id, image_id, category_id, x, y, w, h), categories(id, name)."""
    images = X.files(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("ab12cd-"), F.col("filename")).alias("file_name"), (100 + F.col("doc_id") % 400).cast("int").alias("width"), (80 + F.col("doc_id") % 300).cast("int").alias("height")
    )
    e = F.col("event_id")
    annotations = table(spark, sf_dir, "events").select(
        e.alias("id"), F.col("user_id").alias("image_id"), (e % 30).cast("int").alias("category_id"), (e % 50).cast("double").alias("x"), (e % 40).cast("double").alias("y"), (5 + e % 20).cast("double").alias("w"), (4 + e % 10).cast("double").alias("h")
    )
    return images, annotations, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


COCO = f"""{X.F1}, im as (select doc_id as id, filename, 100+cast(doc_id%400 as int) as width, 80+cast(doc_id%300 as int) as height from f1),
 an as (select event_id as id, user_id as image_id, cast(event_id%30 as int) as category_id, cast(event_id%50 as double) as x, cast(event_id%40 as double) as y, 5+cast(event_id%20 as double) as w, 4+cast(event_id%10 as double) as h from events)"""


@query(f"with {COCO} select an.id, round(x/width, 6) as bx, round(y/height, 6) as b_y, round(w/width, 6) as bw, round(h/height, 6) as bh from an join im on im.id = an.image_id")
def bbox_normalize(spark, sf_dir):
    images, annotations, _ = coco(spark, sf_dir)
    rows = annotations.join(images.withColumnRenamed("id", "image_id"), "image_id")
    box = L.box_normalized(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    return rows.select("id", box.alias("b")).select("id", *[F.round(F.col("b")[i], 6).alias(c) for i, c in enumerate(("bx", "b_y", "bw", "bh"))])


@query(
    f"""with {COCO}, d as (select filename, max(id) as id from im group by filename)
 select f.doc_id, d.id as image_id from f1 f left join d on d.filename = f.filename"""
)
def join_coco_to_images(spark, sf_dir):
    """Samples find their detection image by cleaned name; of equal names the last image wins."""
    images, _, _ = coco(spark, sf_dir)
    by_name = merges.last_wins(images.select(names.clean_annotation_name(F.col("file_name")).alias("filename"), F.col("id").alias("image_id"), F.col("id").alias("place")), ["filename"], "place")
    return X.files(spark, sf_dir).select("doc_id", "filename").join(by_name, "filename", "left").select("doc_id", "image_id")


def detections(spark, sf_dir):
    """Annotations with the name of their category, and how one is shown."""
    images, annotations, categories = coco(spark, sf_dir)
    rows = annotations.join(images.select(F.col("id").alias("image_id")), "image_id").join(categories.withColumnRenamed("id", "category_id"), "category_id", "left")
    label = F.coalesce("name", F.col("category_id").cast("string"))
    return rows, F.concat(label, F.lit(":"), F.col("x").cast("int").cast("string"))


@query(
    f"""with {COCO} select image_id, count(*) as n, string_agg(concat(coalesce(n.n_name, cast(category_id as string)), ':', cast(cast(x as int) as string)), '|' order by an.id) as found
 from an join im on im.id = an.image_id left join nation n on n.n_nationkey = an.category_id group by image_id"""
)
def detections_by_image(spark, sf_dir):
    """Detections of an image in order, with category names; shown as text."""
    rows, shown = detections(spark, sf_dir)
    found = F.transform(F.array_sort(F.collect_list(F.struct("id", shown.alias("t")))), lambda s: s["t"])
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.array_join(found, "|").alias("found"))


@query(
    f"""with {COCO}, c as (select image_id, an.id, (row_number() over (partition by image_id order by an.id) - 1)//3 as chunk, concat(coalesce(n.n_name, cast(category_id as string)), ':', cast(cast(x as int) as string)) as shown
  from an join im on im.id = an.image_id left join nation n on n.n_nationkey = an.category_id)
 select image_id, chunk::bigint as chunk, count(*) as n, string_agg(shown, '|' order by id) as found from c group by image_id, chunk"""
)
def detection_chunks(spark, sf_dir):
    """The same in lists of three at most, so that an image with very many detections is no single row."""
    rows, shown = detections(spark, sf_dir)
    found = chunks.chunked(rows.select("image_id", "id", shown.alias("shown")), "image_id", ["id"], F.col("shown"), 3)
    return found.select("image_id", "chunk", "n", F.array_join("found", "|").alias("found"))


@query(
    f"""with {COCO}, s as (select f.doc_id, f.doc_id%13 <> 1 as matched, exists (select 1 from an where an.image_id=f.doc_id) as has from f1 f)
 select count(*) filter (matched and has) as merged, count(*) filter (not matched) as missing, count(*) filter (matched and not has) as empty from s"""
)
def detection_import_counts(spark, sf_dir):
    """How many samples got detections, had no match, or had a match without detections; some images are left out."""
    images, annotations, _ = coco(spark, sf_dir)
    known = images.filter("id % 13 <> 1").select(F.col("id").alias("doc_id"), F.lit(True).alias("matched"))
    has = annotations.groupBy(F.col("image_id").alias("doc_id")).agg(F.lit(True).alias("has"))
    rows = X.files(spark, sf_dir).select("doc_id").join(known, "doc_id", "left").join(has, "doc_id", "left")
    matched, has = F.coalesce("matched", F.lit(False)), F.coalesce("has", F.lit(False))
    return rows.agg(F.count_if(matched & has).alias("merged"), F.count_if(~matched).alias("missing"), F.count_if(matched & ~has).alias("empty"))


def sample_files(spark, sf_dir):
    """A file of each document in a subfolder, and one of the same name in the folder itself for every third."""
    i = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    above = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("images/"), i, F.lit(".png")).alias("path"))
    return docs.select(F.concat(F.lit("images/sub/"), i, F.lit(".png")).alias("path")).union(above)


SAMPLES = "s as (select doc_id, false as above, concat('images/sub/', doc_id, '.png') as path from documents union all select doc_id, true, concat('images/', doc_id, '.png') from documents where doc_id%3=0)"


@query(
    f"""with {TASKS}, {SAMPLES}, o as (select *, row_number() over (partition by task, label order by r, i) as k from r),
 l as (select task, string_agg(concat(label, '@', coalesce(cast(round(conf*10) as int), -1)), '|' order by r, i) as labels from o where k=1 and task%9 <> 0 group by task),
 im as (select doc_id as id, 100+cast(doc_id%400 as int) as width, 80+cast(doc_id%300 as int) as height from documents where doc_id%7 <> 1),
 b as (select im.id, event_id, (row_number() over (partition by im.id order by event_id)-1)//32 as chunk,
   concat(coalesce(n_name, cast(event_id%30 as string)), ':', cast(floor(1000*(cast(event_id%50 as double)/width)) as int), ':', cast(floor(1000*(cast(4+event_id%10 as double)/height)) as int)) as shown
  from events join im on im.id = user_id left join nation on n_nationkey = event_id%30),
 c as (select id, chunk, string_agg(shown, '|' order by event_id) as boxes from b group by id, chunk)
 select path, labels, coalesce(c.chunk, 0)::bigint as chunk, boxes, case when im.id is null then 'missing' when c.id is null then 'empty' else 'merged' end as outcome
 from s left join l on l.task = s.doc_id and (above or doc_id%3 <> 0) left join im on im.id = s.doc_id left join c on c.id = s.doc_id"""
)
def annotated_samples(spark, sf_dir):
    """Samples with the labels of task files and the boxes of detection images, in fields of given names; shown as text."""
    rows, _ = samples.with_classifications(sample_files(spark, sf_dir), written_tasks(spark, sf_dir), "images", "seen_as")
    images, annotations, categories = coco(spark, sf_dir)
    images = images.filter("id % 7 <> 1").withColumn("file_name", F.concat(F.lit("ab12cd-"), F.col("id").cast("string"), F.lit(".png")))
    rows = samples.with_detections(rows, images, annotations, categories, "boxes_at", 32)
    label = lambda s: F.concat(s["label"], F.lit("@"), F.coalesce(F.round(s["confidence"] * 10).cast("int"), F.lit(-1)).cast("string"))
    share = lambda s, i: F.floor(1000 * s["bounding_box"][i]).cast("string")
    box = lambda s: F.concat_ws(":", s["label"], share(s, 0), share(s, 3))
    return rows.select("path", F.array_join(F.transform("seen_as", label), "|").alias("labels"), "chunk", F.array_join(F.transform("boxes_at", box), "|").alias("boxes"), "outcome")


@query(
    f"""with {TASKS}, {SAMPLES}, w as (select distinct task from t where task%9 <> 0)
 select w.task, case when w.task%3=0 and d.doc_id is not null then concat('images/', w.task, '.png') when d.doc_id is not null then concat('images/sub/', w.task, '.png') end as path,
 case when d.doc_id is null then 'missing' else 'labelled' end as outcome from w left join (select doc_id from documents where doc_id%5 <> 2) d on d.doc_id = w.task"""
)
def classification_outcomes(spark, sf_dir):
    """Which file each task labelled, or that there is none; every fifth document has no files."""
    kept = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long") % 5 != 2
    return samples.with_classifications(sample_files(spark, sf_dir).filter(kept), written_tasks(spark, sf_dir), "images")[1]


@query("select event_id, coalesce(json_extract_string(props, '$.page'), 'none') as page, coalesce(json_extract_string(props, '$.k'), 'none') as k from events")
def json_extract(spark, sf_dir):
    """Optional members with a default."""
    get = lambda c: F.coalesce(F.get_json_object(F.col("props").cast("string"), f"$.{c}"), F.lit("none")).alias(c)
    return table(spark, sf_dir, "events").select("event_id", get("page"), get("k"))


@query("with m as (select 'n' || n_nationkey as k, n_name from nation where n_nationkey < 10) select c_custkey, coalesce(m.n_name, 'other') as name from customer left join m on m.k = 'n' || c_nationkey")
def map_lookup_default(spark, sf_dir):
    """A lookup in a map of ten entries, with a default."""
    nations = table(spark, sf_dir, "nation").filter("n_nationkey < 10").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey"), "n_name"))).alias("m"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("k"))
    return rows.crossJoin(F.broadcast(nations)).select("c_custkey", L.lookup(F.col("m"), F.col("k"), F.lit("other")).alias("name"))


@query("select concat('images/train/', cast(doc_id as string), '.png') as path, toxic as class_id from labels")
def explode_label_map(spark, sf_dir):
    """JSON objects of path to class, one a source row, as rows."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("images/train/"), F.col("doc_id").cast("string"), F.lit(".png"))), F.array("toxic"))).alias("text"))
    return rows.select(F.explode(F.from_json("text", "map<string,int>")).alias("path", "class_id"))
