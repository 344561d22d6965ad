"""Fitting by epochs against numpy, stored models, and the queries that have no SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import models as M
from scanlake.operators import ranks
from scanlake.plans import modelling


def data(spark, n, features, classes, seed):
    rnd = np.random.default_rng(seed)
    x, w = rnd.normal(size=(n, features)), rnd.normal(size=(features, classes))
    y = (x @ w + rnd.gumbel(size=(n, classes))).argmax(axis=1)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)], "k int, values array<double>, label double")
    return df, x, y


def steps(batches, val, x, y, classes, epochs, rate, seed, w):
    """The same training in numpy, one batch after another."""
    order, log, best = np.random.default_rng(seed), [], None
    ones = np.c_[x, np.ones(len(x))]

    def measure(at, w):
        z = ones[at] @ w.T
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return -np.log(p[np.arange(len(at)), y[at]]).mean(), (z.argmax(axis=1) == y[at]).sum(), p

    for epoch in range(1, epochs + 1):
        for b in order.permutation(sorted(batches)).tolist():
            at = batches[b]
            loss, right, p = measure(at, w)
            log.append((epoch, "train", b, loss, len(at), right))
            w = w - rate * (p - np.eye(classes)[y[at]]).T @ ones[at] / len(at)
        loss, right, _ = measure(val, w)
        log.append((epoch, "val", 0, loss, len(val), right))
        if best is None or loss < best[0]:
            best = loss, epoch, w
    return log, best, w


@pytest.mark.parametrize("rate", [0.3, 40.0])
def test_epochs_equal_numpy(spark, rate):
    """At the larger rate the loss goes up again, so an earlier epoch's weights are kept."""
    df, x, y = data(spark, 230, 5, 3, 1)
    train, val = df.filter("k % 4 <> 0").repartition(3), df.filter("k % 4 = 0").repartition(2)
    batches = {}
    for r in ranks.minibatches(train, "k", 50, 7).collect():
        batches.setdefault(r.batch, []).append(r.k)
    want, best, last = steps({b: np.array(k) for b, k in batches.items()}, np.arange(0, 230, 4), x, y, 3, 4, rate, 7, np.zeros((3, 6)))
    fit = M.fit_epochs(train, val, "k", 5, 3, size=50, epochs=4, rate=rate, seed=7)
    assert np.allclose(fit.best.weights, best[2]) and fit.best_epoch == best[1] and np.allclose(fit.last.weights, last)
    got = [tuple(r) for r in fit.log.orderBy("epoch", "phase").collect()]
    assert sorted((e, p, b, round(loss, 6), n, c) for e, p, b, loss, n, c in got) == sorted((e, p, b, round(float(loss), 6), n, int(c)) for e, p, b, loss, n, c in want)
    means = {(r.epoch, r.phase): (r.loss, r.accuracy) for r in M.epoch_means(fit.log, "epoch", "phase").collect()}
    own = [w for w in want if w[:2] == (2, "train")]
    assert np.allclose(means[2, "train"], (sum(w[3] * w[4] for w in own) / sum(w[4] for w in own), sum(w[5] for w in own) / sum(w[4] for w in own)), atol=1e-6)


def test_epochs_at_the_edges(spark):
    df, *_ = data(spark, 30, 2, 2, 3)
    none = df.filter("k < 0")
    fit = M.fit_epochs(df, none, "k", 2, 2, size=8, epochs=2)
    assert fit.best_epoch == 2 and (fit.best.weights == fit.last.weights).all()
    more = M.fit_epochs(df, none, "k", 2, 2, size=8, epochs=1, start=fit.last)
    assert not np.allclose(more.last.weights, fit.last.weights)
    with pytest.raises(ValueError, match="no rows"):
        M.fit_epochs(none, df, "k", 2, 2)
    with pytest.raises(Exception, match="does not have 3 values"):
        M.fit_epochs(df, none, "k", 3, 2)


def test_stored_models_score_alike(spark, tmp_path):
    df, *_ = data(spark, 80, 4, 2, 5)
    fits = {"regression": M.fit_classifier(df), "perceptron": M.fit_perceptron(df, [4, 3, 2]), "array": M.fit_epochs(df, df, "k", 4, 2, epochs=1).best}
    for kind, model in fits.items():
        root, score = str(tmp_path / kind), M.score_arrays if kind == "array" else M.score
        M.save_model(spark, model, root)
        loaded = M.load_model(spark, root, kind=kind, features=4, classes=2)
        assert sorted(score(loaded, df, "k").collect()) == sorted(score(model, df, "k").collect())
        for wrong in ({"features": 5}, {"classes": 3}, {"kind": "other"}, {"layers": [4, 9, 2]}):
            with pytest.raises(ValueError, match="the stored model has"):
                M.load_model(spark, root, **wrong)
    assert M.load_model(spark, str(tmp_path / "perceptron"), layers=[4, 3, 2]).getLayers() == [4, 3, 2]
    with pytest.raises(ValueError, match="no stored model"):
        M.load_model(spark, str(tmp_path / "none"))


def test_array_models_are_scored_in_batches(spark):
    df, x, _ = data(spark, 50, 4, 3, 6)
    model = M.Softmax(np.random.default_rng(2).normal(size=(3, 5)))
    z = x @ model.weights[:, :-1].T + model.weights[:, -1]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    for r in M.score_arrays(model, df.repartition(3), "k").collect():
        assert r.pred == p[r.k].argmax() and abs(r.confidence - p[r.k].max()) < 1e-9


def by_hand(spark, sf_dir, model):
    """vec_id to (path, label, class, confidence) by the model's coefficients."""
    found = {}
    for r in modelling.labelled(spark, sf_dir).collect():
        z = model.coefficientMatrix.toArray() @ np.array(r.values) + model.interceptVector.toArray()
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        found[r.vec_id] = (r.path, r.label, int(p.argmax()), p.max())
    return found


def test_scores_come_from_a_model_that_is_fitted_once(spark, sf_dir, tmp_path, monkeypatch):
    fits, fit = [], M.fit_classifier
    monkeypatch.setattr(modelling, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(M, "fit_classifier", lambda rows: fits.append(1) or fit(rows))
    got = [{r.vec_id: (r.path, r.label, r.pred, r.confidence) for r in modelling.score_images(spark, sf_dir).collect()} for _ in range(2)]
    one = modelling.score_one_image(spark, sf_dir).collect()
    assert len(fits) == 1 and got[0] == got[1]
    want = by_hand(spark, sf_dir, modelling.stored(spark, sf_dir))
    assert set(want) == set(got[0]) and all(w[:3] == g[:3] and abs(w[3] - g[3]) < 1e-9 for w, g in ((want[k], got[0][k]) for k in want))
    assert [tuple(r) for r in one] == [(7, *got[0][7])]
    fresh = M.score(fit(modelling.labelled(spark, sf_dir)), modelling.labelled(spark, sf_dir), "vec_id").collect()
    assert all(abs(r.confidence - got[0][r.vec_id][3]) < 1e-6 and r.pred == got[0][r.vec_id][2] for r in fresh)


def test_fit_classifier_query(spark, sf_dir):
    rows = modelling.labelled(spark, sf_dir)
    model = M.fit_classifier(rows.filter("vec_id % 5 <> 0"))
    found = {}
    for k, (_, label, pred, confidence) in by_hand(spark, sf_dir, model).items():
        if k % 5 == 0:
            found.setdefault(label, []).append((pred == label, confidence))
    got = {r.label: (r.n, r.accuracy, r.confidence) for r in modelling.fit_classifier(spark, sf_dir).collect()}
    assert {k: (len(v), round(np.mean([a for a, _ in v]), 3)) for k, v in found.items()} == {k: (n, round(a, 3)) for k, (n, a, _) in got.items()}
    assert all(abs(np.mean([c for _, c in found[k]]) - got[k][2]) < 1e-4 for k in found)


def test_warm_start_query(spark, sf_dir):
    """All rows are counted; the second stage differs from one that starts afresh, and fits its rows better than the first does."""
    got = {(r.label, r.pred): r.n for r in modelling.warm_start_classifier(spark, sf_dir).collect()}
    rows = modelling.labelled(spark, sf_dir)
    first = M.fit_perceptron(rows.filter("vec_id % 2 = 0"), [64, 8, 2])
    second = M.fit_perceptron(rows.filter("vec_id % 2 = 1"), [64, 8, 2], previous=first)
    want = {(r.label, r.pred): r["count"] for r in M.score(second, rows, "label").groupBy("label", "pred").count().collect()}
    assert got == want and sum(got.values()) == rows.count()
    right = lambda m: M.score(m, rows.filter("vec_id % 2 = 1"), "label").filter(F.col("pred") == F.col("label")).count()
    assert right(second) > right(first)


def test_training_curves(spark, sf_dir):
    got = modelling.training_curves(spark, sf_dir).collect()
    assert sorted((r.epoch, r.phase) for r in got) == [(e, p) for e in range(1, 5) for p in ("train", "val")]
    val = {r.epoch: r.loss for r in got if r.phase == "val"}
    assert {r.epoch for r in got if r.best} == {min(val, key=val.get)}
    train = {r.epoch: r.loss for r in got if r.phase == "train"}
    assert train[4] < train[1] and abs(train[1] - np.log(2)) < 0.05
