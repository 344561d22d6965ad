import random
import zlib

import numpy as np

from scanlake.llm import toxicity as T


def rows(n, seed):
    rnd = random.Random(seed)
    common, bad = [f"word{i}" for i in range(500)], ["vile", "rotten", "nasty", "foulest"]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(common, k=rnd.randint(5, 200))
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", ",", "."]))
        docs.append((i, " ".join(words)))
        if rnd.random() < 0.5:
            labels.append((i, 1, int(toxic)))
        docs[-1] = (*docs[-1], int(toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows(3000, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, truth int")
    got = T.toxicity_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "truth").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.row.truth for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_risk_corrects_for_the_prior():
    w, _ = T.fit([np.array([0, 1]), np.array([1])], np.array([40.0, 0]), np.array([20.0, 180]), 2, 0.1)
    assert w[0] > 2 and w[0] > w[1] + 2


def plain_nnpu(positive, unlabelled, width, prior):
    """Non-negative risk on dense rows, one row at a time, as the definition has it."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, T.STEPS + 1):
        as_toxic, p_clean, u_clean = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
        loss_p = loss_u = 0.0
        for x in positive:
            z = np.r_[x, 1.0] @ w
            as_toxic += -np.r_[x, 1.0] / (1 + np.exp(z)) / len(positive)
            p_clean += np.r_[x, 1.0] / (1 + np.exp(-z)) / len(positive)
            loss_p += np.log1p(np.exp(z)) / len(positive)
        for x in unlabelled:
            z = np.r_[x, 1.0] @ w
            u_clean += np.r_[x, 1.0] / (1 + np.exp(-z)) / len(unlabelled)
            loss_u += np.log1p(np.exp(z)) / len(unlabelled)
        g = prior * as_toxic + u_clean - prior * p_clean if loss_u >= prior * loss_p else prior * p_clean - u_clean
        g[:-1] += T.DECAY * prior / len(positive) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - T.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1]


def test_fit_on_counted_lists_is_the_plain_fit_on_all_rows(monkeypatch):
    monkeypatch.setattr(T, "STEPS", 60)
    rnd = np.random.default_rng(3)
    positive = (rnd.random((30, 4)) < [0.7, 0.5, 0.3, 0.2]).astype(float)
    unlabelled = np.r_[(rnd.random((90, 4)) < [0.05, 0.1, 0.2, 0.2]), (rnd.random((10, 4)) < [0.7, 0.5, 0.3, 0.2])].astype(float)
    lists = sorted({tuple(x) for x in [*positive, *unlabelled]})
    count = lambda rows: np.array([sum(tuple(x) == k for x in rows) for k in lists], dtype=float)
    w, bias = T.fit([np.flatnonzero(k) for k in lists], count(positive), count(unlabelled), 4, 0.1, T.STEPS)
    assert np.allclose(w, plain_nnpu(positive, unlabelled, 4, 0.1), atol=1e-6)
    assert abs((1 / (1 + np.exp(-(unlabelled @ w + bias)))).mean() - 0.1) < 1e-6


def test_all_training_rows_are_unlabelled_text(spark, monkeypatch):
    """Every training row counts on the unlabelled side, in one classifier or in several, labelled or not."""
    docs, labels = rows(600, 4)
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fit, seen = T._listed, []

    def watched(rows, shared):
        out = fit(rows, shared)
        seen.append(out.agg({"n": "sum"}).first()[0])
        return out

    monkeypatch.setattr(T, "_listed", watched)
    one = {r.doc_id: r.score for r in T.toxicity_scores(df, marks).collect()}
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in docs)
    monkeypatch.setattr(T, "LISTS", 6)
    several = {r.doc_id: r.score for r in T.toxicity_scores(df, marks).collect()}
    agree = sum((one[i] >= 0.5) == (several[i] >= 0.5) for i in one)
    assert agree > 0.97 * len(one)
    every = spark.createDataFrame([(i, 1, t) for i, _, t in docs], "doc_id long, quality int, toxic int")
    assert sum(r.predicted for r in T.toxicity_scores(df, every).collect()) > 0.1 * len(docs)  # labels may cover all rows


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = rows(400, 2)
    df = spark.createDataFrame(docs, "doc_id long, text string, truth int")
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in T.toxicity_scores(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(edge_docs, labels, "score", "lang").collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 and r.predicted == 0 for r in T.toxicity_scores(edge_docs, nothing).collect())
    assert T.toxicity_scores(no_docs, labels).count() == 0
