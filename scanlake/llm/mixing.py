"""Mixing sources to target weights (operator 9) by iterative proportional fitting.

Token masses of the cells (one value of each margin) are raked: in turn for each margin, cells are scaled so that their
sums meet that margin's targets, until all margins fit. A document is then sampled with a probability proportional to the
ratio of its cell's raked weight to its mass, so the expected tokens of a sample follow the targets. The factor is calibrated
so that the expected sample has the wanted share of all tokens; a probability cannot exceed 1, and cells that would need more are
kept whole. The choice is a hash of the id, so the same rows are taken again after a lost executor.

Tokens are those of a tokenizer's model (token_counts). Topics are learnt: a text is the counts of its words (what spaces and line feeds part) in DIMENSIONS hash buckets (square
roots, weighted by how few texts have the bucket), and TOPICS centres are fitted to the directions of all texts by spherical k-means, a sum over
the tasks for each sweep; a text has the topic of its nearest centre. Counts and tokens are worked out from whole texts once and written with the row;
sweeps read a copy of the vectors alone, which is deleted when topics are fitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import removed, slices, text_of, with_texts, written
from scanlake.llm.token_counts import Counts, pre_tokens
from scanlake.llm.words import word_hashes_of

SWEEPS, TOLERANCE, GRID = 200, 1e-6, 64
#: Cells that one task may rake; more are raked by joins, with a table written after each sweep.
IN_ONE_TASK = 100_000
#: Sweeps end early where no centre moves by more than MOVED. Directions are summed as whole numbers of 1 / FINE, so that no order of tasks shows.
TOPICS, DIMENSIONS, ROUNDS, STARTS, MOVED, FINE = 8, 512, 10, 4096, 1e-3, 1 << 20
#: Bytes of a batch's texts that are numbered together, about; a longer text is alone.
TOGETHER = 12 << 20
#: Vectors that are worked on together: few, so that they stay in a core's cache.
ROWS = 512
#: The number that each 16 bits stand for as a float16: a look-up is several times faster than numpy's conversion.
HALVES = np.arange(1 << 16, dtype="<u2").view("<f2").astype(np.float32)


def word_vectors(found: pa.DictionaryArray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Each of so many texts' square roots of word counts by hash bucket, from their numbered pre-tokens, in lower case and without space around."""
    words = pc.ascii_trim_whitespace(pc.ascii_lower(found.dictionary))
    bucket = np.where(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), (word_hashes_of(words) % np.uint64(DIMENSIONS)).astype(np.int64), -1)
    bucket = bucket[found.indices.to_numpy()] if len(doc) else np.zeros(0, dtype=np.int64)
    counts = np.bincount(doc[bucket >= 0] * DIMENSIONS + bucket[bucket >= 0], minlength=texts * DIMENSIONS)
    return np.sqrt(counts.reshape(-1, DIMENSIONS).astype(np.float32))


def numbered(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, int]:
    pieces, doc = pre_tokens(texts)
    return pieces.dictionary_encode(), doc, len(texts)


def together(batches):
    """Cut batches of `with_texts` into pieces whose texts have TOGETHER bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, TOGETHER + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, to - at)
            at = to


def directions(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = vectors * weights
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of float32 from vectors as written (float16, little-endian), without nulls."""
    if not len(vectors):
        return np.zeros((0, DIMENSIONS), np.float32)
    ends = np.frombuffer(vectors.buffers()[1], dtype=np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    return HALVES[np.frombuffer(vectors.buffers()[2], dtype="<u2", offset=int(ends[0]), count=len(vectors) * DIMENSIONS)].reshape(-1, DIMENSIONS)


def described(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs: row (a struct of its columns), n_tokens and vector (see word_vectors), null for texts without words."""
    rows = with_texts(docs, F.struct(*docs.columns).alias("row"), tuple(docs.columns))

    def run(batches):
        counts = Counts(model, {})
        for batch in together(batches):
            pieces = numbered(text_of(batch))
            vectors = [v.tobytes() if v.any() else None for v in word_vectors(*pieces).astype("<f2")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.of_pieces(*pieces)), pa.array(vectors, pa.binary())], names=["row", "n_tokens", "vector"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, vector binary")


def bucket_weights(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """The weight of each bucket, from the number of texts that have it, and the number of texts."""

    def count(batches):
        n, held = 0, np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in slices(batches, ROWS):
            x = matrix(batch.column(0))
            n, held = n + len(x), held + (x > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.r_[n, held], pa.int64())], names=["bucket", "n"])

    found = dict(map(tuple, vectors.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()))
    n, held = found.get(-1, 0), np.array([found.get(i, 0) for i in range(DIMENSIONS)])
    return (np.log((n + 1) / (held + 1)) + 0.01).astype(np.float32), n


def first_centres(x: np.ndarray, seed: int) -> np.ndarray:
    """At most TOPICS directions to begin with: rows of x that are far from each other, drawn one after another, then moved to the middle of the rows nearest to them."""
    rnd = np.random.default_rng(seed)
    x = x[np.lexsort(x.T)]
    centres = x[[rnd.integers(len(x))]]
    while len(centres) < min(TOPICS, len(x)):
        far = np.maximum(0, 1 - (x @ centres.T).max(axis=1)).astype(float)
        if far.sum() < 1e-6:
            break
        centres = np.r_[centres, x[[rnd.choice(len(x), p=far / far.sum())]]]
    for _ in range(3 * ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        centres = directions(np.stack([x[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))]), np.float32(1))
    return centres


def swept(vectors: DataFrame, weights: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the directions that are nearest to each centre, in whole numbers of 1 / FINE, and their numbers."""

    def run(batches):
        sums, n = np.zeros((len(centres), DIMENSIONS), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        for batch in slices(batches, ROWS):
            x = directions(matrix(batch.column(0)), weights)
            own = (x @ centres.T).argmax(axis=1)
            chosen = (own[:, None] == np.arange(len(centres))).astype(np.float64)
            sums += (chosen.T @ np.rint(x * FINE)).astype(np.int64)  # whole numbers below 2 ** 53, so exact
            n += np.bincount(own, minlength=len(centres))
        cells = np.c_[n, sums]
        k, at = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(cells[k, at], pa.int64())], names=["k", "at", "v"])

    cells = np.zeros((len(centres), DIMENSIONS + 1), dtype=np.int64)
    for k, at, v in vectors.mapInArrow(run, "k int, at int, v long").groupBy("k", "at").agg(F.sum("v")).collect():
        cells[k, at] = v
    return cells[:, 1:], cells[:, 0]


def fit_topics(vectors: DataFrame, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket weights and at most TOPICS centres, in descending order of their texts, from all rows of vectors(vector), without nulls.

    Sweeps begin at centres fitted to the STARTS different rows with the smallest hashes; every sweep is over all rows.
    """
    weights, n = bucket_weights(vectors)
    if not n:
        return weights, np.zeros((0, DIMENSIONS), np.float32)
    key = F.xxhash64("vector").alias("key")
    least = [r.key for r in vectors.select(key).distinct().orderBy("key").limit(STARTS).collect()]
    starts = vectors.select(key, "vector").filter(F.col("key") <= least[-1]).groupBy("key").agg(F.min("vector").alias("vector")).orderBy("key").collect()
    centres = first_centres(directions(matrix(pa.array([bytes(r.vector) for r in starts], pa.binary())), weights), seed)
    for _ in range(ROUNDS):
        sums, sizes = swept(vectors, weights, centres)
        moved = np.where(sizes[:, None] > 0, directions(sums.astype(np.float64), 1.0), centres).astype(np.float32)
        done, centres = np.abs(moved - centres).max() <= MOVED, moved
        if done:
            break
    return weights, centres[np.argsort(-sizes, kind="stable")]


def topic_of(topics, vector: Column) -> Column:
    """The topic of a vector ("empty" where it is null), by broadcast weights and centres."""

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        weights, centres = topics.value
        own, some = np.zeros(len(vectors), dtype=np.int32), vectors.is_valid().to_numpy(zero_copy_only=False)
        found = vectors.drop_null()
        if len(found):
            own[some] = np.concatenate([(directions(matrix(found.slice(at, ROWS)), weights) @ centres.T).argmax(axis=1) for at in range(0, len(found), ROWS)])
        return pa.array(own, mask=~some)

    return F.coalesce(F.concat(F.lit("topic "), nearest(vector).cast("string")), F.lit("empty"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets (margin, share) that flatten what there is: shares proportional to mass ** power; no mass, no target."""
    sums = cells.groupBy(margin).agg(F.sum("mass").alias("mass")).filter("mass > 0").select(margin, F.pow("mass", F.lit(power)).alias("share"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("share").alias("all")))).select(margin, (F.col("share") / F.col("all")).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with `weight`, in proportion to mass within what the targets ask, and `off`; the weights sum to 1.

    off: by which share a margin missed its target at most in the last sweep. It is over `tolerance` where fitting has not converged, as
    when cells without mass make the targets contradict each other.
    Values without a target get weight 0, and targets whose value has no mass are left out; the rest share their part.
    """
    cells = cells.filter("mass > 0").withColumn("weight", F.col("mass").cast("double"))
    for margin, shares in targets.items():
        cells = cells.join(shares.select(margin, F.col("share").alias(f"to_{margin}")), margin)
    cells = written(cells, "cells")
    if cells.count() <= IN_ONE_TASK:
        return _raked_at_once(cells, list(targets), sweeps, tolerance)
    for _ in range(sweeps):
        worst = F.lit(0.0)
        for margin in targets:
            sums = cells.groupBy(margin).agg(F.sum("weight").alias("now"), F.first(f"to_{margin}").alias("wanted"))
            sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("wanted").alias("asked"))))
            cells = cells.join(sums.select(margin, "now", (F.col("wanted") / F.col("asked")).alias("wanted")), margin)
            cells = cells.withColumn(f"off_{margin}", F.abs(F.col("now") / F.col("wanted") - 1)).withColumn("weight", F.col("weight") * F.col("wanted") / F.col("now")).drop("now", "wanted")
            worst = F.greatest(worst, F.col(f"off_{margin}"))
        cells = written(cells.drop("off").withColumn("off", worst).drop(*[f"off_{m}" for m in targets]), "cells")
        if (cells.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    worst = cells.agg(F.max("off")).first()[0] if "off" in cells.columns else None
    return cells.select(*targets, "mass", "weight", F.lit(worst).cast("double").alias("off"))


def _raked_at_once(cells: DataFrame, margins: list[str], sweeps: int, tolerance: float) -> DataFrame:
    def rake(group: pd.DataFrame) -> pd.DataFrame:
        weight = group["weight"].to_numpy(copy=True)
        codes = [np.unique(group[m], return_index=True, return_inverse=True) for m in margins]
        wanted = [group[f"to_{m}"].to_numpy()[first] for m, (_, first, _) in zip(margins, codes, strict=True)]
        off = 0.0
        for _ in range(sweeps):
            off = 0.0
            for (_, _, code), want in zip(codes, wanted, strict=True):
                factor = want / want.sum() / np.bincount(code, weights=weight)
                weight *= factor[code]
                off = max(off, np.abs(factor - 1).max())
            if off <= tolerance:
                break
        return group[[*margins, "mass"]].assign(weight=weight, off=off)

    schema = ", ".join([*(f"{m} string" for m in margins), "mass long", "weight double", "off double"])
    return cells.withColumn("_all", F.lit("")).groupBy("_all").applyInPandas(rake, schema)


def scale(cells: DataFrame, share: float) -> float:
    """The factor c for which the sum of mass * min(1, c * weight / mass) is `share` of all mass, from three passes over a grid."""
    ratio = F.col("weight") / F.col("mass")
    total, lo, hi = cells.agg(F.sum("mass"), F.min(F.when(F.col("weight") > 0, 1 / ratio)), F.max(F.when(F.col("weight") > 0, 1 / ratio))).first()
    if not total or lo is None:
        return 0.0
    lo, hi = lo * min(1.0, share) / 2, hi * 1.01
    for _ in range(3):
        grid = [lo * (hi / lo) ** (i / GRID) for i in range(GRID + 1)]
        tried = cells.select("mass", ratio.alias("ratio"), F.posexplode(F.array(*map(F.lit, grid))).alias("i", "c"))
        sums = dict(map(tuple, tried.groupBy("i").agg(F.sum(F.col("mass") * F.least(F.lit(1.0), F.col("ratio") * F.col("c")))).collect()))
        at = next((i for i in range(GRID + 1) if sums[i] >= share * total * (1 - 1e-12)), GRID)
        lo, hi = grid[max(0, at - 1)], grid[at]
    return hi


def mixed(docs: DataFrame, powers: dict[str, float], share: float, model: str, seed: int = 42) -> DataFrame:
    """Per row of docs: `row` (a struct of its columns), n_tokens, topic, weight (of the cell), off, probability and kept.

    powers: for each margin (a column of docs, or "topic", the learnt one; a column of docs of that name is carried but not used) how its
    targets flatten what there is (1: as it is, 0: uniform). share: of all tokens, in the expected sample. model: a tokenizer's file. off:
    how far the fit is from its targets (see raked). A null in a margin is a value of its own. Documents without tokens weigh nothing and
    are kept (probability 1). Rows that repeat a doc_id share its draw; a null doc_id draws by its text. Very long texts
    are counted whole and are kept or not as any other row of their cell. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    value = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    names = {f"_m{i}": c for i, c in enumerate(powers)}
    rows = written(described(docs, model), "described")
    vectors = written(rows.select("vector").filter("vector is not null"), "vectors")
    topics = spark.sparkContext.broadcast(fit_topics(vectors))
    removed(vectors)
    rows = rows.select("row", "n_tokens", topic_of(topics, F.col("vector")).alias("topic"))
    keyed = rows.select("*", *[value(F.col("topic") if c == "topic" else F.col(f"row.{c}")).alias(m) for m, c in names.items()])
    cells = written(keyed.groupBy(*names).agg(F.sum("n_tokens").alias("mass")), "masses")
    fitted = written(raked(cells, {m: written(tempered(cells, m, p), "targets") for m, p in zip(names, powers.values(), strict=True)}), "weights")
    factor = scale(fitted, share)
    chances = fitted.select(*names, "weight", "off", F.least(F.lit(1.0), F.col("weight") / F.col("mass") * factor).alias("probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text:"), F.col("row.text")), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)
    out = keyed.join(chances, [*names], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    out = out.withColumn("probability", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0))))
    return out.withColumn("kept", draw < F.col("probability")).drop(*names)
