"""Exact top-k inner products (operator 8) over an impact-ordered index, score at a time.

Rows are dealt to blocks. A task builds the index of a block once and queries stream past it, so that a row is shuffled once and
neither side is broadcast or held whole. A block's index has, for each component, its rows in order of the integer component, cut into posting segments by quantised impact.
For a query, segments are processed by descending contribution (weight times largest impact) and added to accumulators.
What a row can still gain is bounded by the next segment of each component. Processing stops when few rows can reach the
k-th best score that is already proven, or no segment can add anything; those rows are scored exactly.

Queries search one block first. The k-th score that each has found there is proven for all blocks: a query passes over a block whose
bound does not reach it, and stops the sooner in the others. That first block is copied to each lot of QUERIES queries, four rows
a query, so that its search is not one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, written
from scanlake.llm.vectors import matrix, valid_vectors

ROWS, QUERIES, LEVELS, ROUND = 16_384, 4_096, 6, 24
#: In a lane the rows of its block come first, then the queries.
HELD, ASKED = 0, 1
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Index:
    """Posting segments of one block of integer rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.segments = []  # per component: (rows, impacts) by descending impact, and the same for ascending
        for column in x.T:
            order = np.argsort(-column, kind="stable")
            self.segments.append((self._cut(order, column), self._cut(order[::-1], -column)))

    @staticmethod
    def _cut(order: np.ndarray, impact: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(largest impact, rows, impacts) of each quantised level, as far as impacts are positive."""
        values = impact[order]
        order, values = order[values > 0], values[values > 0]
        if not len(values):
            return []
        level = values * LEVELS // (values[0] + 1)
        at = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
        return [(int(values[a]), order[a:b], values[a:b]) for a, b in zip(at, np.r_[at[1:], len(values)], strict=True)]

    def search(self, query: np.ndarray, k: int, own: int, ids: np.ndarray, proven: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows, own excepted; ties to the smaller id. Rows under a score that is proven may be left out."""
        n = len(self.x)
        total = np.zeros(n, dtype=np.int64)
        plan = []
        for d in np.flatnonzero(query):
            weight = abs(int(query[d]))
            plan += [(weight * s[0], d, i, weight, s[1], s[2]) for i, s in enumerate(self.segments[d][int(query[d] < 0)])]
        plan.sort(key=lambda p: -p[0])
        following = {}  # what the next segment of a component can add
        for p in plan:
            following.setdefault(p[1], []).append(p[0])
        rest, done = sum(f[0] for f in following.values()), {d: 0 for d in following}
        if proven is not None and rest < proven:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        possible = np.arange(n)
        for at in range(0, len(plan), ROUND):
            for most, d, _, weight, rows, values in plan[at : at + ROUND]:
                total[rows] += weight * values
                done[d] += 1
                rest += (following[d][done[d]] if done[d] < len(following[d]) else 0) - most
            best = np.argpartition(-total, min(n - 1, 4 * k))[: 4 * k + 1]
            best = best[best != own]
            scores = np.sort(self.x[best] @ query)[::-1]
            if len(scores) >= k and (proven is None or scores[k - 1] > proven):
                proven = scores[k - 1]
            if proven is not None:
                possible = np.flatnonzero(total + rest >= proven)
                if len(possible) <= max(8 * k, n // 64):
                    break
        possible = possible[possible != own]
        scores = self.x[possible] @ query
        order = np.lexsort((ids[possible], -scores))[:k]
        return possible[order], scores[order]


def quantised(vectors, width: int) -> np.ndarray:
    x = np.floor(256 * matrix(vectors, width))
    if width and np.abs(x).max(initial=0) ** 2 * width >= 2.0**62:
        raise ValueError("components are too large for scores of 64 bits")
    return x.astype(np.int64)


class Block:
    """The rows of one block as they arrive, indexed when the first query comes."""

    def __init__(self, lane: int):
        self.lane, self.ids, self.vectors, self.index = lane, [], [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.ids += rows["vec_id"].to_pylist()
        self.vectors += rows["vector"].to_pylist()

    def search(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k best rows of this block for each query."""
        vectors = queries["vector"].to_pylist()
        if self.index is None:
            self.width = max((len(v) // 8 for v in self.vectors), default=0)
            self.index, self.ids = Index(quantised(self.vectors, self.width)), np.array(self.ids, dtype=np.int64)
            self.place = {v: i for i, v in enumerate(self.ids.tolist())}
        width = max(self.width, max((len(v) // 8 for v in vectors), default=0))
        q = quantised(vectors, width)[:, : self.width]
        parts = []
        for query_id, query, proven in zip(queries["vec_id"].to_pylist(), q, queries["proven"].to_pylist(), strict=True):
            at, scores = self.index.search(query, k, self.place.get(query_id, -1), self.ids, proven)
            parts.append((np.full(len(at), query_id), self.ids[at], scores))
        return batch_of(FOUND, *[np.concatenate([p[i] for p in parts]) for i in range(3)])


def lane_pieces(batches):
    """(lane, kind, rows) of neighbouring rows with the same lane and kind, at most an Arrow batch at a time."""
    for batch in batches:
        lane, kind = batch["lane"].to_numpy(), batch["kind"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (kind[1:] != kind[:-1])]) if len(lane) else []
        for a, b in zip(starts, np.r_[starts[1:], len(lane)].astype(int), strict=True):
            yield int(lane[a]), int(kind[a]), batch.slice(a, b - a)


def top_k(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other rows by integer inner product of floor(256 * x).

    Ties go to the smaller vec_id; with fewer than k other rows all are returned. Rows whose vec_id or vector is null, or
    whose vector holds null or non-finite components, take no part; rows that repeat a vec_id count once; shorter vectors
    count as zero beyond their end. Other columns are ignored; an empty table gives an empty result. Scores are 64-bit integers:
    components so large that a score might not fit (about 8 million at 64 components; more at fewer) raise.
    """
    vectors = valid_vectors(embeddings)
    total = embeddings.count()
    n_rows, n_queries = max(1, -(-total // ROWS)), max(1, -(-embeddings.filter(is_query).count() // QUERIES))
    rows = vectors.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int"), "kind": F.lit(HELD), "proven": F.lit(None).cast("long")})
    queries = vectors.filter(is_query).select(F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("lot"), "vec_id", "vector")
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))

    def searched(batches):
        block = None
        for lane, kind, piece in lane_pieces(batches):
            if block is None or block.lane != lane:
                block = Block(lane)
            if kind == HELD:
                block.add(piece)
            elif len(block.ids):
                yield block.search(piece, k)

    def search(held: DataFrame, asked: DataFrame) -> DataFrame:
        """Queries in the block of their lane: a lane's rows come first in its task, then its queries."""
        lanes = [t.select("lane", "kind", "vec_id", "vector", "proven") for t in (held, asked.withColumn("kind", F.lit(ASKED)))]
        return lanes[0].union(lanes[1]).repartition("lane").sortWithinPartitions("lane", "kind").mapInArrow(searched, "query_id long, vec_id long, score long")

    first = rows.filter("block = 0").withColumn("lane", each(0, n_queries - 1))
    found = search(first, queries.withColumns({"lane": F.col("lot"), "proven": F.lit(None).cast("long")}))
    if n_rows > 1:
        found = written(found, "found")
        best = found.groupBy(F.col("query_id").alias("proven_for")).agg(F.when(F.count("*") >= k, F.min("score")).alias("proven"))
        known = queries.join(best, F.col("vec_id") == F.col("proven_for"), "left").select("vec_id", "vector", "proven")
        asked = written(known, "queries").withColumn("lane", each(1, n_rows - 1))
        found = found.union(search(rows.filter("block > 0").withColumn("lane", F.col("block")), asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
