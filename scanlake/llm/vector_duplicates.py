"""Embedding near-duplicates (operator 10) by a forest of random-projection trees.

Each tree halves the space again and again at the median of a random direction, one for each level of a tree, which tasks draw from a
seed; vectors within a margin of a cut go down both sides (spill), so that near pairs are seldom parted, and several trees make up for
those that are. The first cuts are fitted on a sample of at most SAMPLE vectors; every vector is then placed in all its leaves. Leaves of
more than LARGE classes, which a large table has, are split again by a tree of their own, fitted on a sample of their members, and so on,
so that leaves keep their size while the table grows. Pairs are compared within leaves only, by cosine in double precision, and links are united to components.

Equal vectors become one class first. A leaf returns, for each of its classes, how many vectors it links to and an edge to the
smallest id that it reaches there, never pairs. A pair that shares several leaves counts in the first of them. Leaves of
more than BLOCK classes, such as those of many vectors that no cut parts, are compared in pairs of blocks, which are tasks of their own.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, written
from scanlake.llm.components import components
from scanlake.llm.vectors import matrix, valid_vectors

TREES, LEAF, SAMPLE, FEWEST, BLOCK = 8, 512, 65_536, 8, 2_048
#: Spill on each side of a cut, times the root of the vectors' length: projections of two near vectors are apart in that proportion.
MARGIN = 0.16
#: Classes of a leaf that is split again; members (about) that its tree is fitted on; members (about) that a task places; bits for a leaf's number in that tree; times.
LARGE, MEMBERS, PLACED, BITS, TIMES = 8_192, 4_096, 16_384, 13, 3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size: components are divided by the largest first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def short(x: np.ndarray) -> bytes:
    """A vector's components in 4 bytes each where that keeps them whole, else in 8; the first byte tells."""
    with np.errstate(over="ignore"):
        less = x.astype("<f4")
    return b"\4" + less.tobytes() if np.array_equal(less, x) else b"\x08" + x.astype("<f8").tobytes()


def long(vectors) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=f"<f{v[0]}", offset=1) for v in vectors]).astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1, which rounds nothing but what vanishes beside it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny))[1])


def cosines(x: np.ndarray, least: float) -> np.ndarray:
    """Cosines of all pairs of rows; those that rounding might move past `least` are worked out from the components as they are."""
    own = unit(x)
    found = own @ own.T
    i, j = np.nonzero(np.abs(found - least) < 1e-9)
    if len(i):
        x = scaled(x)
        length = np.sqrt((x * x).sum(axis=1))
        for lo in range(0, len(i), 65_536):
            a, b = i[lo : lo + 65_536], j[lo : lo + 65_536]
            found[a, b] = (x[a] * x[b]).sum(axis=1) / (length[a] * length[b])
    return found


def direction(seed: int, level: int, width: int) -> np.ndarray:
    found = np.random.default_rng([seed, level]).standard_normal(width)
    return found / np.linalg.norm(found)


def margin_of(width: int) -> float:
    return MARGIN / max(1, width) ** 0.5


def grow(sample: np.ndarray, leaf: float, seed: int, most: int | None = None) -> list[tuple]:
    """A tree as a list of nodes (at most `most`): (level, cut, left node, right node), or None for a leaf."""
    nodes, work, projected = [None], deque([(0, 0, np.arange(len(sample)))]), {}
    margin = margin_of(sample.shape[1])
    while work:
        node, level, own = work.popleft()
        if len(own) <= leaf or (most and len(nodes) + 2 > most):
            continue
        if level not in projected:
            projected[level] = sample @ direction(seed, level, sample.shape[1])
        at = projected[level][own]
        cut = float(np.median(at))
        sides = [own[at < cut + margin], own[at >= cut - margin]]
        if max(map(len, sides)) > 0.9 * len(own):  # too dense to be cut; compared in blocks
            continue
        nodes[node] = (level, cut, len(nodes), len(nodes) + 1)
        work += [(len(nodes), level + 1, sides[0]), (len(nodes) + 1, level + 1, sides[1])]
        nodes += [None, None]
    return nodes


def leaves(trees: list[list], x: np.ndarray, seeds: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each row of x in each leaf that it reaches; leaves are numbered through all trees, whose seeds are their places if not given."""
    rows, found, base = [], [], 0
    margin = margin_of(x.shape[1])
    for seed, nodes in zip(seeds or range(len(trees)), trees, strict=True):
        depth = max((n[0] + 1 for n in nodes if n), default=0)
        projected = x @ np.array([direction(seed, k, x.shape[1]) for k in range(depth)]).T if depth else None
        work = [(0, np.arange(len(x)))]
        while work:
            node, own = work.pop()
            if nodes[node] is None:
                rows.append(own)
                found.append(np.full(len(own), base + node, dtype=np.int64))
                continue
            level, cut, left, right = nodes[node]
            at = projected[own, level]
            sides = own[at < cut + margin], own[at >= cut - margin]
            work += [(to, side) for to, side in zip((left, right), sides, strict=True) if len(side)]
        base += len(nodes)
    return np.concatenate(rows), np.concatenate(found)


def compare(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, places: list[np.ndarray], leaf: int, sides: np.ndarray, least: float) -> pd.DataFrame:
    """Classes of one leaf or of two blocks of it: id, vectors linked here first, and the smallest id reached.

    sides: the block of each class; with two blocks, only pairs across them count.
    """
    linked = cosines(x, least) >= least
    np.fill_diagonal(linked, False)
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return pd.DataFrame({"id": [0] * 0, "links": [0] * 0, "low": [0] * 0})
    linked, ids, sizes = linked[np.ix_(some, some)], ids[some], sizes[some]
    earlier = [p[p < leaf] for p in (places[i] for i in some)]
    names, column = np.unique(np.concatenate(earlier), return_inverse=True)
    row = np.repeat(np.arange(len(some)), [len(e) for e in earlier])
    shared = np.zeros((len(some), len(some)), dtype=np.float32)
    for lo in range(0, len(names), 2048):
        part = (column >= lo) & (column < lo + 2048)
        member = np.zeros((len(some), min(2048, len(names) - lo)), dtype=np.float32)
        member[row[part], column[part] - lo] = 1
        shared += member @ member.T
    links = (linked & (shared == 0)) @ sizes
    low = ids.copy()
    while True:
        lower = np.minimum(low, np.where(linked, low[None], np.iinfo(np.int64).max).min(axis=1))
        if (lower == low).all():
            return pd.DataFrame({"id": ids, "links": links, "low": low}).astype("int64")
        low = lower


def split_again(rows: DataFrame) -> DataFrame:
    """rows(leaf, id, size, vector, places), with leaves of more than LARGE classes split, TIMES at most; leaves and places are numbered anew.

    A leaf's tree is fitted on about MEMBERS of its members, and its members are placed by tasks of about PLACED each, so a leaf that a third
    of all vectors reach is no single task. Leaves that no cut parts stay as they are. The order of leaves is the same for all vectors.
    """
    names = ("level", "cut", "left", "right")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(group["leaf"].iloc[0]), int(group["n"].iloc[0])
        nodes = grow(unit(long(group["vector"])), max(FEWEST, LEAF * len(group) / n), TREES + leaf, 1 << BITS)
        columns = zip(*(node or (-1, 0.0, 0, 0) for node in nodes), strict=True)
        return pd.DataFrame({"leaf": [leaf], **{c: [list(v)] for c, v in zip(names, columns, strict=True)}})

    def placed(group: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group[["leaf", "id", "size", "vector"]]
        leaf = int(group["leaf"].iloc[0])
        nodes = [node if node[0] >= 0 else None for node in zip(*(tree[c].iloc[0] for c in names), strict=True)] if len(tree) else [None]
        row, node = leaves([nodes], unit(long(group["vector"])), [TREES + leaf])
        return group[["id", "size", "vector"]].iloc[row].assign(leaf=(leaf << BITS) + node)[["leaf", "id", "size", "vector"]]

    first, found = rows, rows.select("leaf", "id", "size", "vector")
    for turn in range(TIMES):
        sizes = found.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE)
        if turn:  # what was not parted before is not tried again
            sizes = sizes.filter(F.col("leaf").bitwiseAND((1 << BITS) - 1) != 0)
        sizes = written(sizes, "large")
        if sizes.isEmpty():
            break
        large = found.join(sizes, "leaf")
        sample = large.filter(F.pmod(F.xxhash64("id", "leaf"), F.lit(1_000_000)) < 1_000_000 * F.lit(MEMBERS) / F.col("n"))
        trees = written(sample.groupBy("leaf").applyInPandas(fitted, "leaf long, level array<int>, cut array<double>, left array<int>, right array<int>"), "trees")
        parts = F.ceil(F.col("n") / PLACED).cast("int")
        dealt = large.withColumn("part", F.pmod(F.xxhash64("id"), parts)).select("leaf", "part", "id", "size", "vector")
        sent = trees.join(sizes, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("n")
        again = dealt.groupBy("leaf", "part").cogroup(sent.groupBy("leaf", "part")).applyInPandas(placed, "leaf long, id long, size long, vector binary")
        kept = found.join(sizes, "leaf", "left_anti").select((F.col("leaf") * (1 << BITS)).alias("leaf"), "id", "size", "vector")
        found = written(kept.union(again), "leaves")
        rows = found
    if rows is first:
        return first
    places = found.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("places"))
    return written(found.join(places, "id").select("leaf", "id", "size", "vector", "places"), "leaves")


def vector_duplicates(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, zero or hold null or non-finite components link with nothing: 0 links, their own component, kept.
    A null vec_id gives a null component_id and is kept. Rows that repeat a vec_id are one vector (the smallest). Vectors of
    different lengths are compared as if the shorter ended in zeros. Other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    nonzero = "exists(embedding, x -> x is null or x <> 0)"
    vectors = valid_vectors(embeddings.filter(nonzero))
    members = written(vectors, "vectors")
    classes = members.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = written(classes, "classes")
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0))).first()
    drawn = classes.select("vector").filter(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * SAMPLE / max(1, total)))).limit(SAMPLE)
    sample = [bytes(r.vector) for r in drawn.collect()]
    x = unit(matrix(sample, width // 8))
    leaf = max(FEWEST, LEAF * len(sample) / max(1, total))
    shared = spark.sparkContext.broadcast([grow(x, leaf, seed) for seed in range(TREES)])
    schema = pa.schema([("leaf", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("vector", pa.binary()), ("places", pa.list_(pa.int32()))])

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column(0).to_pylist(), width // 8)
            vectors = [short(v) for v in own]
            row, leaf = leaves(shared.value, unit(own))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            at = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)]
            places = [leaf[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            ids, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo in range(0, len(row), 8192):
                part = slice(lo, lo + 8192)
                yield batch_of(schema, leaf[part], ids[row[part]], sizes[row[part]], [vectors[i] for i in row[part]], [places[i] for i in row[part]])

    in_leaves = written(classes.select("vector", "id", "size").mapInArrow(placed, "leaf long, id long, size long, vector binary, places array<int>"), "leaves")
    in_leaves = split_again(in_leaves)
    blocks = written(in_leaves.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = in_leaves.join(blocks, "leaf").withColumn("own", F.expr("cast(pmod(xxhash64(id, leaf), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        return compare(group["id"].to_numpy(), group["size"].to_numpy(), long(group["vector"]), list(group["places"]), int(group["leaf"].iloc[0]), group["own"].to_numpy(), least)

    found = dealt.groupBy("leaf", "i", "j").applyInPandas(compared, "id long, links long, low long")
    found = written(found, "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    of_class = classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(groups, "id", "left")
    of_class = written(of_class.select("vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "classes")
    of_vector = members.join(of_class, "vector").select("vec_id", "n_links", "component_id")
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).join(of_vector, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
