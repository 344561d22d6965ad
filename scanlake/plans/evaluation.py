"""Queries on predictions: scores, losses and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake import fixtures as X
from scanlake.functions import scores
from scanlake.operators import models
from scanlake.operators.ranks import exact_median
from scanlake.registry import query, table

PRED = f"{X.F4}, pred as (select vec_id, y, case when z1 > z0 then 1 else 0 end as pred, round(1/(1+exp(-abs(z0-z1))), 6) as conf, ln(exp(z0)+exp(z1)) - case when y=0 then z0 else z1 end as ce from f4)"
TEN = f"{X.F4_TEN}, e as (select *, list_max(z) as top from ten), s as (select *, list_sum(list_transform(z, lambda x: exp(x - top))) as total from e)"


def predictions(spark, sf_dir) -> DataFrame:
    """vec_id, y, pred, conf (rounded to 6), ce."""
    z = F.array("z0", "z1")
    rows = X.logits(spark, sf_dir).withColumn("p", scores.softmax(z))
    return rows.select("vec_id", "y", scores.argmax(F.col("p")).alias("pred"), F.round(F.array_max("p"), 6).alias("conf"), scores.cross_entropy(z, F.col("y")).alias("ce"))


@query(f"with {TEN} select vec_id, round(exp(z[1]-top)/total, 6) as p0, round(exp(z[10]-top)/total, 6) as p9, round(list_max(list_transform(z, lambda x: exp(x-top)/total)), 6) as p_max from s")
def softmax(spark, sf_dir):
    p = X.ten_logits(spark, sf_dir).select("vec_id", scores.softmax(F.col("z")).alias("p"))
    return p.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[9], 6).alias("p9"), F.round(F.array_max("p"), 6).alias("p_max"))


@query(f"with {TEN} select vec_id, cast(list_position(z, top) - 1 as int) as pred, round(1/total, 6) as confidence from s")
def argmax_confidence(spark, sf_dir):
    p = X.ten_logits(spark, sf_dir).select("vec_id", scores.softmax(F.col("z")).alias("p"))
    return p.select("vec_id", scores.argmax(F.col("p")).alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"))


@query(f"with {TEN} select y, round(avg(ln(total) + top - z[y+1]), 6) as loss, count(*) as n from s group by y")
def cross_entropy(spark, sf_dir):
    rows = X.ten_logits(spark, sf_dir)
    return rows.groupBy("y").agg(F.round(F.avg(scores.cross_entropy(F.col("z"), F.col("y"))), 6).alias("loss"), F.count("*").alias("n"))


@query(f"with {X.F4} select vec_id, round(greatest(z0, 0) - z0*y + ln(1 + exp(-abs(z0))), 6) as loss from f4")
def bce_with_logits(spark, sf_dir):
    return X.logits(spark, sf_dir).select("vec_id", F.round(scores.bce_with_logits(F.col("z0"), F.col("y")), 6).alias("loss"))


@query(
    f"""with {X.F4}, b as (select cast(floor(vec_id/32.0) as bigint) as batch, z0, z1, greatest(z0,0) - z0 + ln(1+exp(-abs(z0))) as real_1, greatest(z1,0) + ln(1+exp(-abs(z1))) as fake_0, greatest(z1,0) - z1 + ln(1+exp(-abs(z1))) as fake_1, vec_id%2 as phase from f4)
 select batch, round(avg(real_1) + avg(case when phase=0 then fake_0 end), 6) as d_loss, round(avg(case when phase=1 then fake_1 end), 6) as g_loss from b group by batch"""
)
def adversarial_losses(spark, sf_dir):
    """Per batch: the discriminator's loss on real and fake logits, the generator's on fresh fakes (phase 1)."""
    bce = lambda z, t: scores.bce_with_logits(F.col(z), F.lit(t))
    rows = X.logits(spark, sf_dir).withColumns({"batch": F.floor(F.col("vec_id") / 32), "phase": F.col("vec_id") % 2})
    return rows.groupBy("batch").agg(
        F.round(F.avg(bce("z0", 1.0)) + F.avg(F.when(F.col("phase") == 0, bce("z1", 0.0))), 6).alias("d_loss"), F.round(F.avg(F.when(F.col("phase") == 1, bce("z1", 1.0))), 6).alias("g_loss")
    )


@query(f"with {PRED} select vec_id, y, pred, conf from pred where y <> pred")
def filter_misclassified(spark, sf_dir):
    return predictions(spark, sf_dir).filter("y <> pred").select("vec_id", "y", "pred", "conf")


@query(
    """select l_linenumber as epoch, round(sum(l_discount*cast(l_quantity as int))/greatest(1, sum(cast(l_quantity as int))), 6)::double as loss,
 round(sum(cast(floor(l_quantity*l_discount*10) as int))/greatest(1, sum(cast(l_quantity as int))), 6)::double as accuracy from lineitem group by l_linenumber"""
)
def epoch_metrics(spark, sf_dir):
    """Loss and accuracy of an epoch from its batches, weighted by their sizes."""
    n = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), n.alias("n"), F.col("l_discount").cast("double").alias("loss"), F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("int").alias("correct"))
    return models.epoch_means(rows, "epoch")


@query(f"with {PRED} select round(avg(ce), 6) as loss, round(avg(case when y=pred then 1.0 else 0.0 end), 6)::double as accuracy, count(*) as n from pred")
def eval_loss_accuracy(spark, sf_dir):
    right = (F.col("y") == F.col("pred")).cast("int")
    return predictions(spark, sf_dir).agg(F.round(F.avg("ce"), 6).alias("loss"), F.round(F.avg(right), 6).alias("accuracy"), F.count("*").alias("n"))


MATRIX = f"{PRED}, k as (select cast(unnest(range(3)) as int) as c), cm as (select a.c as y, b.c as pred, count(p.y) as n from k a cross join k b left join pred p on p.y=a.c and p.pred=b.c group by a.c, b.c)"


def matrix(rows: DataFrame, classes: int) -> DataFrame:
    """y, pred, n for every pair of classes; pairs that never occur have 0."""
    spark = rows.sparkSession
    side = lambda c: spark.range(classes).select(F.col("id").cast("int").alias(c))
    counts = rows.groupBy("y", "pred").agg(F.count("*").alias("n"))
    return side("y").crossJoin(side("pred")).join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {MATRIX} select y, pred, n from cm")
def confusion_matrix(spark, sf_dir):
    """Three classes, of which the third never occurs."""
    return matrix(predictions(spark, sf_dir), 3)


@query(
    f"""with {MATRIX}, s as (select k.c, sum(case when y=k.c and pred=k.c then n else 0 end) as tp, sum(case when pred=k.c and y<>k.c then n else 0 end) as fp, sum(case when y=k.c and pred<>k.c then n else 0 end) as fn from k cross join cm group by k.c),
 r as (select c, tp/(tp+fp+1e-9::double) as p, tp/(tp+fn+1e-9::double) as q from s) select c as class_id, round(p, 6) as "precision", round(q, 6) as recall, round(2*p*q/(p+q+1e-9::double), 6) as f1 from r"""
)
def precision_recall_f1(spark, sf_dir):
    cells = matrix(predictions(spark, sf_dir), 3)
    side = lambda c: cells.groupBy(F.col(c).alias("class_id")).agg(F.sum("n").alias(f"by_{c}"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    rows = side("y").join(side("pred").drop("tp"), "class_id")
    p, r = (F.col("tp") / (F.col(c) + 1e-9) for c in ("by_pred", "by_y"))
    return rows.select("class_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r + 1e-9), 6).alias("f1"))


@query(f"with {PRED} select round(avg(conf), 6) as mean, min(conf) as min, max(conf) as max, round(quantile_cont(conf, 0.5), 6) as median from pred")
def confidence_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    middle = F.lit(exact_median(rows, "conf")).cast("double")
    return rows.agg(F.round(F.avg("conf"), 6).alias("mean"), F.min("conf").alias("min"), F.max("conf").alias("max")).withColumn("median", F.round(middle, 6))


@query(f"with {PRED} select round(avg(case when y=pred then conf end), 6) as correct, round(avg(case when y<>pred then conf end), 6) as incorrect from pred")
def confidence_by_correctness(spark, sf_dir):
    right = F.col("y") == F.col("pred")
    return predictions(spark, sf_dir).agg(F.round(F.avg(F.when(right, F.col("conf"))), 6).alias("correct"), F.round(F.avg(F.when(~right, F.col("conf"))), 6).alias("incorrect"))


def histogram(rows: DataFrame, key: str, bins: int = 20) -> DataFrame:
    """key, bin, n: equal bins between each key's own least and largest conf; the last bin is closed."""
    ends = rows.groupBy(key).agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    place = F.least(F.floor((F.col("conf") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    # A row for each part, so the parts, of which one has half of all rows, need no shuffle.
    return rows.join(F.broadcast(ends), key).withColumn("bin", F.coalesce(place, F.lit(0)).cast("int")).groupBy(key, "bin").agg(F.count("*").alias("n"))


@query(
    f"""with {PRED}, g as (select 'all' as part, conf from pred union all select case when y=pred then 'correct' else 'incorrect' end, conf from pred), e as (select part, min(conf) as lo, max(conf) as hi from g group by part)
 select part, cast(coalesce(least(floor((conf-lo)/nullif(hi-lo, 0)*20), 19), 0) as int) as bin, count(*) as n from g join e using (part) group by 1, 2"""
)
def confidence_histogram(spark, sf_dir):
    """Twenty bins over all predictions, and over correct and incorrect ones."""
    rows = predictions(spark, sf_dir)
    parts = F.array(F.lit("all"), F.when(F.col("y") == F.col("pred"), "correct").otherwise("incorrect"))
    return histogram(rows.select(F.explode(parts).alias("part"), "conf"), "part")


@query(f"with {PRED} select vec_id, y, pred, conf from pred where y <> pred order by conf desc, vec_id limit 10")
def top_confident_wrong(spark, sf_dir):
    return predictions(spark, sf_dir).filter("y <> pred").select("vec_id", "y", "pred", "conf").orderBy(F.desc("conf"), "vec_id").limit(10)
