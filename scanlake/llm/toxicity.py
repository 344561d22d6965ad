"""Toxicity (operator 3): non-negative positive-unlabelled learning of linear classifiers in numpy.

Positives are rows that labels confirm as toxic; the unlabelled side is the text of all training rows, whatever is known of them. With the
class prior p, the risk of calling unlabelled text clean is corrected by what its toxic share must contribute:
    p * R(positive as toxic) + max(0, R(unlabelled as clean) - p * R(positive as clean)).
When the corrected part turns negative, the step goes against it instead (the classifier has begun to learn rows by heart).

Features are the presence of a word and of its first 3, 4 and 5 characters, if SHARE of the positives has them.
1. Positives are at most about POSITIVES rows (a documented bound for labelled rows); what is not rare among them is a candidate.
2. Candidates are counted in all training rows, and the LARGEST most telling ones at most are the features.
3. A training row is now the short list of its features. Equal lists are one row with a count, so that the risk is that of all rows. Lists are
   dealt to a classifier for each LISTS of them, which has all positives; their weights are averaged by rows. A linear score of averaged
   weights is the mean of the classifiers' scores, so scoring costs the same with any number of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, slices, text_of, texts, with_texts, written

POSITIVES, LISTS = 6000, 200_000
COMMON, SHARE, LEAST, LIFT, LARGEST = 3, 0.01, 2.0, 4.0, 500
STEPS, RATE, DECAY = 500, 0.05, 1.0
EDGE = b".,;:!?\"'()[]{}|*#%&$-"
#: Distinct lists of features that a task keeps before it sends their counts on, and words that it remembers.
TOGETHER, WORDS = 50_000, 1 << 17


def word_features(word: bytes) -> tuple[str, ...]:
    """A word in lower case without punctuation at its ends, and its beginnings, which end in a hyphen."""
    text = word.lower().strip(EDGE).decode("utf-8", "replace")
    return (text, *(f"{text[:n]}-" for n in (3, 4, 5) if len(text) > n)) if text else ()


class Features(dict):
    """Word to its features; with a table of names, to the numbers of those that are in it."""

    def __init__(self, names: dict[str, int] | None = None):
        super().__init__()
        self.names = names

    def __missing__(self, word: bytes) -> tuple:
        if len(self) >= WORDS:
            self.clear()
        found = word_features(word)
        if self.names is not None:
            found = tuple(n for n in map(self.names.get, found) if n is not None)
        self[word] = found
        return found

    def of(self, text: bytes | None) -> set:
        return set().union(*map(self.__getitem__, set((text or b"").split())))


def telling(in_positive: np.ndarray, in_unlabelled: np.ndarray, n_pos: int, n_unl: int, prior: float) -> np.ndarray:
    """The features, by the rows they are in, that mark toxic text best: at most LARGEST, in SHARE of toxic rows at least, and LIFT times as
    often there as in clean text.

    How often clean text has a feature is what unlabelled text shows less the share that its toxic part accounts for.
    """
    toxic = in_positive / n_pos
    clean = np.maximum(0, in_unlabelled / n_unl - prior * toxic) / (1 - prior)
    score = (toxic - clean) / np.sqrt(toxic / n_pos + clean / n_unl + 1e-12)
    used = np.flatnonzero((score >= LEAST) & (toxic >= LIFT * np.maximum(clean, 0.5 / n_unl)) & (in_positive >= max(COMMON, SHARE * n_pos)))
    return used[np.argsort(-score[used], kind="stable")][:LARGEST]


def fit(lists: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss.

    lists: the features of each distinct row; positive, unlabelled: how many positive and unlabelled rows each stands for.
    """
    own = np.repeat(np.arange(len(lists)), [len(r) for r in lists])
    column = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, dtype=np.int64)
    n_pos, of_pos, of_unl = positive.sum(), positive / positive.sum(), unlabelled / unlabelled.sum()
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    logits = lambda: np.bincount(own, weights=w[column], minlength=len(lists)) + w[-1]
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        z = logits()
        p, as_clean = chance(z), np.logaddexp(0, z)
        corrected = (of_unl - prior * of_pos) * p
        negative = (of_unl - prior * of_pos) @ as_clean < 0
        by_row = -corrected if negative else corrected - prior * of_pos * (1 - p)
        g = np.r_[np.bincount(column, weights=by_row[own], minlength=width) + DECAY * prior / n_pos * w[:-1], by_row.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # The bias is where the mean probability of unlabelled rows is the class prior.
    z = logits() - w[-1]
    lo, hi = -60.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if of_unl @ chance(z + mid) < prior else (lo, mid)
    return w[:-1], (lo + hi) / 2


def candidates(sample: DataFrame, n_pos: int) -> dict[str, int]:
    """(feature: positives that have it) of those in SHARE of them, COMMON at least: at most 1 / SHARE times what a positive has on average."""

    def featured(batches):
        features = Features()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features.of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["found"])

    found = sample.select("text").mapInArrow(featured, "found array<string>").select(F.explode("found").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return dict(map(tuple, found.filter(F.col("n") >= max(COMMON, SHARE * n_pos)).collect()))


def _listed(rows: DataFrame, shared) -> DataFrame:
    """(found, n): each list of features of rows(text), and how many rows have it, added up within tasks."""

    def run(batches):
        features, counts = Features(shared.value), {}
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["found", "n"])
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = np.array(sorted(features.of(text)), dtype="<i4").tobytes()
                counts[found] = counts.get(found, 0) + 1
            if len(counts) >= TOGETHER:
                yield give()
                counts.clear()
        yield give()

    return rows.select("text").mapInArrow(run, "found binary, n long").groupBy("found").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, in_training: Column) -> tuple[dict[str, float], float] | None:
    """Weights of features and the bias; none without positives or without training rows."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(in_training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    n_known, n_confirmed = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_confirmed:
        return None
    prior = min(0.5, n_confirmed / n_known)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).filter(in_training)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, POSITIVES / n_confirmed))
    # About POSITIVES ids at most, so this side is small at any size of docs, and texts stay where they are.
    sample = written(rows.join(F.broadcast(known.filter("toxic = 1").filter(drawn).select("doc_id")), "doc_id"), "positives")
    n_pos = sample.count()
    if not n_pos:
        return None
    in_positive = candidates(sample, n_pos)
    names = sorted(in_positive)
    numbered = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def count(batches):
        features, n, total = Features(numbered.value), 0, np.zeros(len(names), dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                n += 1
                total[list(features.of(text))] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(names)), -1]), pa.array([*total.tolist(), n])], names=["at", "n"])

    sums = dict(map(tuple, rows.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect()))
    counts = np.array([in_positive[name] for name in names]), np.array([sums.get(i, 0) for i in range(len(names))])
    used = telling(*counts, n_pos, max(1, sums[-1]), prior)
    shared = spark.sparkContext.broadcast({names[i]: k for k, i in enumerate(used)})
    lists = _listed(rows, shared).withColumn("toxic", F.lit(0))
    lists = written(lists, "lists")
    members = max(1, round(lists.count() / LISTS))
    dealt = lists.withColumn("member", F.pmod(F.xxhash64("found"), F.lit(members)).cast("long"))
    dealt = dealt.union(_listed(sample, shared).withColumn("toxic", F.lit(1)).withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long")))))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        # An order of its own, so that the same rows give the same model however they were shuffled.
        table = group.assign(pos=group["n"] * group["toxic"], unl=group["n"] * (1 - group["toxic"])).groupby("found", sort=True)[["pos", "unl"]].sum()
        pos, unl = table["pos"].to_numpy(float), table["unl"].to_numpy(float)
        if not pos.sum() or not unl.sum():
            return pd.DataFrame({"at": [0] * 0, "sums": [0.0] * 0, "n": [0.0] * 0})
        w, bias = fit([np.frombuffer(f, dtype="<i4") for f in table.index], pos, unl, len(used), prior)
        return pd.DataFrame({"at": range(-1, len(w)), "sums": np.r_[bias, w] * unl.sum(), "n": unl.sum()})

    model = dealt.groupBy("member").applyInPandas(fitted, "at long, sums double, n double").groupBy("at").agg((F.sum("sums") / F.sum("n")).alias("w"))
    weights = dict(map(tuple, model.collect()))
    return ({names[i]: weights[k] for k, i in enumerate(used)}, weights[-1]) if weights else None


def toxicity_scores(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0), and `row`, a struct of the columns
    named in keep (no struct if none are).

    Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0; held_out marks the others. A null doc_id is in
    neither fold (held_out true). Of several labels of one doc_id the largest counts. Null and empty texts have no features and get
    the score of the bias alone; without any positive label every score is 0; an empty table gives an empty result. Only the text
    enters a score; other columns are ignored; repeated rows score alike.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    weights, bias = train(docs, labels, fold != 0) or ({}, None)
    names = {f: i for i, f in enumerate(weights)}
    shared = docs.sparkSession.sparkContext.broadcast((names, np.array(list(weights.values()), dtype=float), bias))
    rows = with_texts(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*keep).alias("row")] if keep else [])).alias("keep"), keep)
    schema = pa.schema([("score", pa.float64())])

    def run(batches):
        names, weights, bias = shared.value
        features = Features(names)
        for batch in slices(batches):
            found = text_of(batch, "row").cast(pa.binary()).to_pylist()
            z = np.array([weights[sorted(features.of(text))].sum() if bias is not None else 0.0 for text in found]) + (bias or 0.0)
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if bias is not None else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch_of(schema, scores).column(0)], names=["keep", "score"])

    out = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, score double").select("keep.*", "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *(["row"] if keep else []))
