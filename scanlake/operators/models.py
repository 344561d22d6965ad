"""Classifiers on image features: pyspark.ml models and a softmax regression by mini-batches, stored models, and batch scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scanlake.functions import scores
from scanlake.operators import ranks
from scanlake.sources import versions
from scanlake.sources.work import new_folder


def with_vectors(rows: DataFrame) -> DataFrame:
    """rows(values array, ...) with the vector column that pyspark.ml needs."""
    return rows.withColumn("features", array_to_vector("values"))


def fit_classifier(rows: DataFrame, label: str = "label", iterations: int = 20):
    """Softmax regression with cross-entropy on rows(values, label)."""
    return LogisticRegression(family="multinomial", labelCol=label, maxIter=iterations, regParam=1e-3).fit(with_vectors(rows))


def fit_perceptron(rows: DataFrame, layers: list[int], previous=None, label: str = "label", iterations: int = 15):
    """A perceptron, from the weights of a previous one with the same layers where given."""
    fitter = MultilayerPerceptronClassifier(layers=layers, labelCol=label, maxIter=iterations, seed=42)
    if previous is not None:
        fitter = fitter.setInitialWeights(previous.weights)
    return fitter.fit(with_vectors(rows))


def score(model, rows: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep, pred and confidence."""
    p = vector_to_array("probability")
    return model.transform(with_vectors(rows)).select(*keep, scores.argmax(p).alias("pred"), F.array_max(p).alias("confidence"))


@dataclass
class Softmax:
    """Softmax regression as an array: a row of weights for each class, the last of which is added as it is."""

    weights: np.ndarray

    @property
    def numFeatures(self) -> int:  # noqa: N802 (as pyspark.ml has it)
        return self.weights.shape[1] - 1

    @property
    def numClasses(self) -> int:  # noqa: N802
        return len(self.weights)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:, :-1].T + self.weights[:, -1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows(values) with `probability`, an array; whole batches are scored at once."""
        predict = predict_batch_udf(lambda: self.probabilities, return_type=ArrayType(DoubleType()), batch_size=1024, input_tensor_shapes=[[self.numFeatures]])
        return rows.withColumn("probability", predict(F.col("values")))


def score_arrays(model: Softmax, rows: DataFrame, *keep: str) -> DataFrame:
    """As `score`, by an array model."""
    return model.transform(rows).select(*keep, scores.argmax(F.col("probability")).alias("pred"), F.array_max("probability").alias("confidence"))


#: Models that can be stored, by the name that is written with them.
KINDS = {"regression": LogisticRegressionModel, "perceptron": MultilayerPerceptronClassificationModel}


def save_model(spark: SparkSession, model, root: str) -> dict:
    """A new version of the model in root, with its kind and shape; it counts once it is complete."""
    told = {"features": model.numFeatures, "classes": model.numClasses}
    if isinstance(model, Softmax):
        rows = [(i, [float(w) for w in row]) for i, row in enumerate(model.weights)]
        return versions.publish(spark, root, lambda folder: spark.createDataFrame(rows, "class int, weights array<double>").write.parquet(folder) or told | {"kind": "array"})
    kind = next(k for k, c in KINDS.items() if isinstance(model, c))
    layers = {"layers": list(model.getLayers())} if kind == "perceptron" else {}
    return versions.publish(spark, root, lambda folder: model.write().save(folder) or told | {"kind": kind} | layers)


def load_model(spark: SparkSession, root: str, **wanted):
    """The stored model. wanted: what it must be (kind, features, classes, layers); a model of another shape raises before it is read."""
    told = versions.current(spark, root)
    if told is None:
        raise ValueError(f"no stored model in {root}")
    wrong = {k: (told.get(k), v) for k, v in wanted.items() if told.get(k) != v}
    if wrong:
        raise ValueError("; ".join(f"the stored model has {k} {has}, not {v}" for k, (has, v) in wrong.items()))
    folder = f"{root}/{told['version']}"
    if told["kind"] == "array":
        return Softmax(np.array([r.weights for r in spark.read.parquet(folder).orderBy("class").collect()]))
    model = KINDS[told["kind"]].load(folder)
    if (model.numFeatures, model.numClasses) != (told["features"], told["classes"]):
        raise ValueError(f"the model in {folder} is not the one that was stored")
    return model


def fitted_once(spark: SparkSession, root: str, fit: Callable, **wanted):
    """The model stored in root; fit() is called, and its model stored, only where none was ever finished."""
    if versions.current(spark, root) is None:
        save_model(spark, fit(), root)
    return load_model(spark, root, **wanted)


def _matrix(values: pa.ListArray, features: int) -> np.ndarray:
    if values.null_count or (np.diff(values.offsets.to_numpy()) != features).any():
        raise ValueError(f"a row does not have {features} values")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _measured(model: Softmax, x: np.ndarray, y: np.ndarray) -> tuple[float, int, np.ndarray]:
    """The sum of losses, the number of right classes (of equal scores the first counts), and the sum of gradients."""
    z = model.logits(x)
    top = z.max(axis=1)
    own, loss = z[np.arange(len(y)), y], top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    p = model.probabilities(x)
    p[np.arange(len(y)), y] -= 1
    return float((loss - own).sum()), int((z.argmax(axis=1) == y).sum()), p.T @ np.c_[x, np.ones(len(x))]


def measured(rows: DataFrame, model: Softmax) -> DataFrame:
    """A row for each partition of rows(values, label): loss, n, correct, and the gradient as one array; sums, to be added up."""

    def run(batches):
        loss, right, n, slope = 0.0, 0, 0, np.zeros_like(model.weights)
        for batch in batches:
            if batch.num_rows:
                part = _measured(model, _matrix(batch.column(0), model.numFeatures), batch.column(1).to_numpy().astype(np.int64))
                loss, right, n, slope = loss + part[0], right + part[1], n + batch.num_rows, slope + part[2]
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([right], pa.int64()), pa.array([slope.ravel().tolist()], pa.list_(pa.float64()))], names=["loss", "n", "correct", "slope"])

    return rows.select("values", F.col("label").cast("long").alias("label")).mapInArrow(run, "loss double, n long, correct long, slope array<double>")


@dataclass
class Fit:
    """What training by epochs gave: the weights of the epoch with the least validation loss, that epoch, those of the last one, and a log.

    log: epoch, phase (train or val), batch, loss (mean), n, correct.
    """

    best: Softmax
    best_epoch: int
    last: Softmax
    log: DataFrame


def fit_epochs(train: DataFrame, val: DataFrame, key: str, features: int, classes: int, size: int = 1024, epochs: int = 5, rate: float = 0.1, start: Softmax | None = None, seed: int = 42) -> Fit:
    """Softmax regression by gradient steps on mini-batches, with a validation pass after each epoch.

    train, val: rows(key, values, label). Rows are dealt to batches once, by their seeded rank, and written in a folder for each, so that a step reads its batch
    alone; epochs visit the batches in seeded orders. A step is one sum of gradients over the tasks that hold the batch, whose number its size bounds.
    start: weights to go on from. Without rows to train on it raises; without any to validate on the last epoch is the best.
    """
    spark, path = train.sparkSession, new_folder(train.sparkSession, "batches")
    ranks.minibatches(train.select(key, "values", "label"), key, size, seed).select("batch", "values", "label").repartition("batch").write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("values array<double>, label double, batch long").parquet(path)
    batches = sorted(r.batch for r in rows.select("batch").distinct().collect())
    if not batches:
        raise ValueError("no rows to train on")
    model = start or Softmax(np.zeros((classes, features + 1)))
    log, best, order = [], None, np.random.default_rng(seed)
    for epoch in range(1, epochs + 1):
        for batch in order.permutation(batches).tolist():
            parts = measured(rows.filter(F.col("batch") == batch), model).collect()
            n, slope = sum(p.n for p in parts), np.sum([p.slope for p in parts], axis=0).reshape(model.weights.shape)
            log.append((epoch, "train", batch, sum(p.loss for p in parts) / n, n, sum(p.correct for p in parts)))
            model = Softmax(model.weights - rate * slope / n)
        loss, n, right = measured(val, model).agg(F.coalesce(F.sum("loss"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("correct"), F.lit(0))).first()
        log.append((epoch, "val", 0, loss / max(1, n), n, right))
        if best is None or not n or loss / n < best[0]:
            best = (loss / max(1, n), epoch, model)
    return Fit(best[2], best[1], model, spark.createDataFrame(log, "epoch int, phase string, batch long, loss double, n long, correct long"))


def epoch_means(rows: DataFrame, *keys: str) -> DataFrame:
    """loss and accuracy by keys from rows(loss, n, correct) of batches, weighted by their sizes."""
    total = F.greatest(F.lit(1), F.sum("n"))
    return rows.groupBy(*keys).agg(F.round(F.sum(F.col("loss") * F.col("n")) / total, 6).alias("loss"), F.round(F.sum("correct") / total, 6).alias("accuracy"))
