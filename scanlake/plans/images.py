"""Queries on pixels: channels, depth, resizing, denoising, features and activation maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.operators import images as I
from scanlake.registry import query, table


@query(f"with {X.F5}, {X.COLOR} select vec_id, y, x, cast(floor((sum(v*case c when 0 then 114 when 1 then 587 else 299 end)+500)/1000.0) as int) as v from color group by vec_id, y, x")
def image_to_gray(spark, sf_dir):
    return I.to_gray(X.pixels(spark, sf_dir, color=True)).select("vec_id", "y", "x", "v")


@query(f"with {X.F5}, {X.GRAY} select vec_id, y, x, cast(k.c as int) as c, v from gray cross join (select unnest(range(3)) as c) k")
def image_to_color(spark, sf_dir):
    return I.to_color(X.pixels(spark, sf_dir)).select("vec_id", "y", "x", "c", "v")


@query(
    f"""with {X.F5}, d as (select vec_id, y, x, cast(floor((v+1)*32767.5) as int) as v from px), e as (select vec_id, min(v) as lo, max(v) as hi from d group by vec_id)
 select vec_id, y, x, cast(floor((v-lo)/(hi-lo+1e-6::double)*65535) as int) as v from d join e using (vec_id)"""
)
def normalize_bit_depth(spark, sf_dir):
    return I.normalize_depth(X.pixels(spark, sf_dir, levels=32767.5)).select("vec_id", "y", "x", "v")


def overlap_sql(target: int) -> str:
    return f"""w as (select t, s, (least((t+1)*8.0::double/{target}, s+1) - greatest(t*8.0::double/{target}, s))/(8.0::double/{target}) as w
 from (select unnest(range({target})) as t) a cross join (select unnest(range(8)) as s) b where least((t+1)*8.0::double/{target}, s+1) - greatest(t*8.0::double/{target}, s) > 1e-12)"""


@query(f"with {X.F5}, {X.GRAY}, {overlap_sql(3)} select vec_id, cast(wy.t as int) as y, cast(wx.t as int) as x, round(sum(v*wy.w*wx.w), 6) as v from gray join w wy on wy.s=y join w wx on wx.s=x group by 1, 2, 3")
def resize_area(spark, sf_dir):
    out = I.resize_area(X.pixels(spark, sf_dir), (3, 3))
    return out.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(
    f"""with {X.F5}, {X.GRAY}, o as (select unnest([-1,0,1]) as d), n as (select g.vec_id, g.y, g.x, m.v from gray g cross join o a cross join o b
 join gray m on m.vec_id=g.vec_id and m.y=least(greatest(g.y+a.d,0),7) and m.x=least(greatest(g.x+b.d,0),7)) select vec_id, y, x, cast(median(v) as int) as v from n group by vec_id, y, x"""
)
def median_denoise(spark, sf_dir):
    return I.median3(X.pixels(spark, sf_dir)).select("vec_id", "y", "x", "v")


BILINEAR = """b as (select t, s, sum(w) as w from (select t, cast(floor(a) as int) as s, 1-(a-floor(a)) as w from q union all select t, cast(least(floor(a)+1, {last}) as int), a-floor(a) from q) u group by t, s having sum(w) > 0),"""
MAP = "q as (select t, least(greatest((t+0.5)*{source}/{target}-0.5, 0), {source}-1)::double as a from (select unnest(range({target})) as t) z), "


def bilinear_sql(source: int, target: int) -> str:
    return MAP.format(source=source, target=target) + BILINEAR.format(last=source - 1)


@query(f"with {X.F5}, {X.GRAY}, {bilinear_sql(8, 5)} r as (select vec_id, by1.t as y, bx.t as x, sum(v*by1.w*bx.w) as v from gray join b by1 on by1.s=y join b bx on bx.s=x group by 1, 2, 3) select vec_id, cast(y as int) as y, cast(x as int) as x, round(v, 5) as v from r")
def resize_bilinear(spark, sf_dir):
    out = I.resize_bilinear(X.pixels(spark, sf_dir), (5, 5))
    return out.select("vec_id", "y", "x", F.round("v", 5).alias("v"))


@query(f"with {X.F5}, {X.GRAY} select vec_id, y, x, round(v/255.0, 6)::double as v from gray")
def scale_to_unit(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("vec_id", "y", "x", F.round(F.col("v") / 255, 6).alias("v"))


@query(f"with {X.F5}, {X.GRAY} select vec_id, y, x, round((v/255.0-0.5)/0.5, 6)::double as v from gray")
def standardize(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("vec_id", "y", "x", F.round((F.col("v") / 255 - 0.5) / 0.5, 6).alias("v"))


def levels(embedding):
    """An image's 64 gray values in order, from the components of a vector; a vector of another length raises."""
    values = F.transform(embedding.cast("array<double>"), lambda v: F.floor((v + 1) * 127.5).cast("int"))
    return F.when(F.size(embedding) == 64, values).otherwise(F.raise_error(F.lit("an image has 64 components")))


def features(spark, sf_dir, *more):
    """vec_id, values (an image's pixels in order, scaled to [0, 1]) and the columns named in more; nothing is shuffled."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.transform(levels(F.col("embedding")), lambda v: v / 255).alias("values"), *more)


@query(f"with {X.F5}, {X.GRAY} select vec_id, count(*) as size, round(max(case when y=0 and x=0 then v/255.0 end), 6)::double as first, round(max(case when y=7 and x=7 then v/255.0 end), 6)::double as last from gray group by vec_id")
def image_features(spark, sf_dir):
    values = F.col("values")
    return features(spark, sf_dir).select("vec_id", F.size(values).cast("long").alias("size"), F.round(values[0], 6).alias("first"), F.round(values[63], 6).alias("last"))


def as_images(spark, sf_dir):
    """8 x 8 gray images: path, height, width, channels, dtype, data."""
    path = F.concat(F.lit("/images/"), F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.lit(".png"))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(path.alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.lit("uint8").alias("dtype"), levels(F.col("embedding")).alias("data"))


MIXED = """mixed as (select vec_id, case when vec_id%2=0 then 8 else 4 end as h, case when vec_id%2=0 then 8 else 16 end as w, p, cast(floor((v+1)*case when vec_id%3=0 then 32767.5 else 127.5 end) as int) as v, vec_id%3=0 as deep from px),
 ends as (select vec_id, min(v) as lo, max(v) as hi from mixed group by vec_id),
 flat as (select vec_id, h, w, cast(floor(p/w::double) as int) as y, cast(p%w as int) as x, case when deep then cast(floor((v-lo)/(hi-lo+1e-6::double)*65535) as int) else v end as v from mixed join ends using (vec_id))"""


@query(
    f"""with {X.F5}, {MIXED}, k as (select unnest(range(3)) as t),
 c as (select vec_id, ky.t as y, kx.t as x, v, (least((ky.t+1)*h/3.0::double, y+1) - greatest(ky.t*h/3.0::double, y))/(h/3.0::double) as wy, (least((kx.t+1)*w/3.0::double, x+1) - greatest(kx.t*w/3.0::double, x))/(w/3.0::double) as wx from flat cross join k ky cross join k kx)
 select vec_id, cast(y as int) as y, cast(x as int) as x, round(sum(v*wy*wx), 4) as v from c where wy > 1e-12 and wx > 1e-12 group by 1, 2, 3"""
)
def resize_mixed_images(spark, sf_dir):
    """Images of two sizes (8 x 8 and 4 x 16) and two depths in one table: 16-bit values stretched, then all resized to 3 x 3 by area, pixel by pixel."""
    deep, width = F.col("vec_id") % 3 == 0, F.when(F.col("vec_id") % 2 == 0, 8).otherwise(16)
    value = F.floor((F.col("v") + 1) * F.when(deep, 32767.5).otherwise(127.5)).cast("int")
    rows = X.components(spark, sf_dir).select("vec_id", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).alias("x"), F.lit(0).alias("c"), value.alias("v"), F.when(deep, "uint16").otherwise("uint8").alias("dtype"))
    return I.resize_area_by_pixel(I.normalize_depth(rows), (3, 3)).select("vec_id", "y", "x", F.round("v", 4).alias("v"))


@query(
    f"""with {X.F5}, {X.GRAY}, r as (select vec_id, cast(floor(y/2.0) as int) as y, cast(floor(x/2.0) as int) as x, cast(floor(avg(v)+0.5) as int) as v from gray group by 1, 2, 3), o as (select unnest([-1,0,1]) as d),
 n as (select g.vec_id, g.y, g.x, m.v from r g cross join o a cross join o b join r m on m.vec_id=g.vec_id and m.y=least(greatest(g.y+a.d,0),3) and m.x=least(greatest(g.x+b.d,0),3)),
 m as (select vec_id, y, x, cast(median(v) as int) as v from n group by vec_id, y, x)
 select concat('/images/', lpad(cast(vec_id as string), 9, '0'), '.png') as path, sum(v)::bigint as total, sum(v*(y*4+x+1))::bigint as place from m group by vec_id"""
)
def preprocess_images(spark, sf_dir):
    """Gray, depth, area resize to 4 x 4 (rounded), median; the image-by-image path, shown as checksums."""
    out = I.preprocess(as_images(spark, sf_dir), (4, 4))
    at = F.posexplode("data").alias("p", "v")
    return out.select("path", at).groupBy("path").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("p") + 1)).alias("place"))


def activations(spark, sf_dir):
    """F8: vec_id, c, y, x, act, grad; four channels of 4 x 4."""
    p = F.col("p")
    rows = X.components(spark, sf_dir)
    return rows.select("vec_id", F.floor(p / 16).cast("int").alias("c"), F.floor((p % 16) / 4).cast("int").alias("y"), (p % 4).cast("int").alias("x"), F.col("v").alias("act"), (F.col("v") * (p % 3 - 1)).alias("grad"))


def heat(rows):
    """vec_id, y, x, v: channels weighted by their mean gradient, negative parts cut, stretched to [0, 1] per image."""
    weights = rows.groupBy("vec_id", "c").agg(F.avg("grad").alias("w"))
    sums = rows.join(weights, ["vec_id", "c"]).groupBy("vec_id", "y", "x").agg(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("act"))).alias("v"))
    ends = sums.groupBy("vec_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return sums.join(ends, "vec_id").select("vec_id", "y", "x", ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)).alias("v"))


HEAT = f"""{X.F5.replace("cast(floor(p/8.0) as int) as y, cast(p%8 as int) as x, p", "p")}, ac as (select vec_id, cast(floor(p/16.0) as int) as c, cast(floor((p%16)/4.0) as int) as y, cast(p%4 as int) as x, v as act, v*(p%3-1) as grad from px),
 wt as (select vec_id, c, avg(grad) as w from ac group by vec_id, c), sm as (select vec_id, y, x, greatest(0, sum(w*act)) as v from ac join wt using (vec_id, c) group by vec_id, y, x),
 en as (select vec_id, min(v) as lo, max(v) as hi from sm group by vec_id), ht as (select vec_id, y, x, (v-lo)/(hi-lo+1e-8::double) as v from sm join en using (vec_id))"""


@query(f"with {HEAT} select vec_id, y, x, round(v, 5) as v from ht")
def activation_map(spark, sf_dir):
    return heat(activations(spark, sf_dir)).select("vec_id", "y", "x", F.round("v", 5).alias("v"))


@query(f"with {HEAT}, {bilinear_sql(4, 8)} r as (select vec_id, by1.t as y, bx.t as x, sum(v*by1.w*bx.w) as v from ht join b by1 on by1.s=y join b bx on bx.s=x group by 1, 2, 3) select vec_id, cast(y as int) as y, cast(x as int) as x, round(v, 5) as v from r")
def activation_map_upsample(spark, sf_dir):
    rows = heat(activations(spark, sf_dir)).withColumn("c", F.lit(0))
    return I.resize_bilinear(rows, (8, 8)).select("vec_id", "y", "x", F.round("v", 5).alias("v"))
