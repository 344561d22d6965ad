"""Queries that fit, store and apply classifiers on image features."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from scanlake.operators import models
from scanlake.plans.images import features
from scanlake.registry import query
from scanlake.sources.work import shared_folder

PIXELS = 64


def labelled(spark, sf_dir):
    """vec_id, path, values, label (two classes)."""
    rows = features(spark, sf_dir, (F.col("label") % 2).cast("double").alias("label"))
    return rows.withColumn("path", F.concat(F.lit("/images/"), F.col("vec_id").cast("string"), F.lit(".png")))


@query()
def fit_classifier(spark, sf_dir):
    """Accuracy and mean confidence of a classifier fitted on four fifths, per class of the rest."""
    rows = labelled(spark, sf_dir)
    model = models.fit_classifier(rows.filter("vec_id % 5 <> 0"))
    found = models.score(model, rows.filter("vec_id % 5 = 0"), "vec_id", "label")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query()
def training_curves(spark, sf_dir):
    """Loss and accuracy of training and validation by epoch, and which epoch's weights are kept; a fifth is held out."""
    rows = labelled(spark, sf_dir)
    fit = models.fit_epochs(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), "vec_id", PIXELS, 2, epochs=4)
    return models.epoch_means(fit.log, "epoch", "phase").withColumn("best", F.col("epoch") == fit.best_epoch)


@query()
def warm_start_classifier(spark, sf_dir):
    """A second stage that starts from the weights of the first."""
    rows = labelled(spark, sf_dir)
    first = models.fit_perceptron(rows.filter("vec_id % 2 = 0"), [PIXELS, 8, 2])
    second = models.fit_perceptron(rows.filter("vec_id % 2 = 1"), [PIXELS, 8, 2], previous=first)
    found = models.score(second, rows, "vec_id", "label")
    return found.groupBy("label", "pred").agg(F.count("*").alias("n"))


def stored(spark, sf_dir):
    """The classifier of a table: fitted when it is first asked for, then loaded. Another table, or other rows in it, has a model of its own."""
    rows = labelled(spark, sf_dir)
    n, digest = rows.agg(F.count("*"), F.sum(F.xxhash64("vec_id", "values", "label").cast("decimal(20, 0)"))).first()
    key = hashlib.sha256(f"{sf_dir}:{n}:{digest}".encode()).hexdigest()
    return models.fitted_once(spark, f"{shared_folder(spark)}/models/{key}", lambda: models.fit_classifier(rows), kind="regression", features=PIXELS, classes=2)


@query()
def score_images(spark, sf_dir):
    """Class and confidence of every image, by the stored model."""
    return models.score(stored(spark, sf_dir), labelled(spark, sf_dir), "vec_id", "path", "label")


@query()
def score_one_image(spark, sf_dir):
    """The same for one path; the filter reaches the scan before any vector is built."""
    return models.score(stored(spark, sf_dir), labelled(spark, sf_dir).filter("path = '/images/7.png'"), "vec_id", "path", "label")
