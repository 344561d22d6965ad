"""Ranked lexical search (operator 11) without random access: NRA over impact-sorted postings.

Documents are read once for each block of queries: the queries' terms are numbered, and a document becomes its length and the counts of those terms.
That table is written; terms are weighed by counts over all of it. Each task then reads its part as shards of bounded size, sorts each term's
postings by impact, and for each query reads the lists from the top, a stretch of each in turn. A document's score is known to lie between the
sum of what was read of it and that sum plus the next impact of each list in which it has not been met. Reading goes on until no other document can
reach the k-th lower end or tie with it and every score that can is exact. Lists that no undecided document waits for are left.

The k-th lower end holds for all that follows: from shard to shard in a task, and, from a first search of a part of the documents, for all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, removed, slices, written

#: What a term may consist of, byte by byte (every byte of a character outside ASCII counts); A-Z become a-z, other bytes a space.
TERM_BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower()], dtype=np.uint8)
#: Pairs of query and term in a block of queries; documents and postings of a shard; texts that are cut together.
BLOCK, SHARD_DOCS, SHARD_POSTINGS, TOGETHER = 1 << 18, 1 << 16, 1 << 22, 64
#: First stretch of a list that is read; stretches double. The first search takes one in so many documents, and so many at most.
STRETCH, SHARE, FIRST = 64, 64, 1 << 20
#: Length normalisation, in hundredths, and saturation, as the score has them.
B, SATURATION, UNIT = 50, 20, 1_000_000_000


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of texts (binary, without nulls) in lower case; empty pieces may stand at either end of a text."""
    texts = texts.cast(pa.binary())
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[sizes[0] : sizes[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((sizes - sizes[0]).astype(np.int32)), pa.py_buffer(TERM_BYTES[data]))
    return pc.ascii_split_whitespace(plain)


def words_and_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = terms_of(texts)
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), row[some.to_numpy(zero_copy_only=False)]


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; items without an id and texts that are null or without terms have none."""

    def cut(batches):
        for batch in slices(batches, TOGETHER):
            words, row = words_and_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words], names=["item_id", "term"])

    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_id long, term string").distinct()


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, times) of documents with at least one term: n counts all terms, the arrays hold numbers and counts of given ones."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def count(batches):
        given = pa.array(known.value, pa.string())
        for batch in slices(batches, TOGETHER):
            words, row = words_and_rows(batch.column(1))
            n = np.bincount(row, minlength=batch.num_rows)
            number = pc.index_in(words, value_set=given)
            met = number.is_valid().to_numpy(zero_copy_only=False)
            key, times = np.unique(row[met] * len(given) + number.filter(pa.array(met)).to_numpy().astype(np.int64), return_counts=True)
            some = np.flatnonzero(n)
            ends = pa.array(np.r_[0, np.searchsorted(key, (some + 1) * len(given))], pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((key % max(1, len(given)), pa.int32()), (times, pa.int64())))
            yield batch_of(schema, batch.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), *lists)

    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Impact-sorted postings of some documents."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, documents: int, length: int):
        m = 100 - B + (B * n * documents) // length
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        impact = (UNIT * times) // (1000 * times + SATURATION * m[doc])
        order = np.lexsort((-impact, terms))
        self.doc, self.impact, self.documents = doc[order], impact[order], len(n)
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, contributions) of each term that is here and adds something, by descending contribution."""
        if not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (weights > 0)
        return [(self.doc[self.starts[i] : self.ends[i]], w * self.impact[self.starts[i] : self.ends[i]]) for i, w in zip(at[here], weights[here], strict=True)]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, proven: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that reach both the k-th best score here and the one that is proven elsewhere; all ties are among them."""
        lists = self.lists(terms, weights)
        head = np.array([c[0] for _, c in lists], dtype=np.int64)  # what a list can still add
        read, stretch, proven = np.zeros(len(lists), dtype=np.int64), STRETCH, max(1, proven)
        if head.sum() < proven:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # What was read of a document, and what lists that it has been met in can still add, but not to it.
        lower, spent = np.zeros(self.documents, dtype=np.int64), np.zeros(self.documents, dtype=np.int64)
        wanted = head > 0
        while True:
            for i in np.flatnonzero(wanted):
                docs, adds = lists[i]
                a, b = read[i], min(len(docs), read[i] + stretch)
                after = adds[b] if b < len(docs) else 0
                lower[docs[a:b]] += adds[a:b]
                spent[docs[:a]] += after - head[i]
                spent[docs[a:b]] += after
                read[i], head[i] = b, after
            stretch *= 2
            if self.documents >= k:
                proven = max(proven, int(np.partition(lower, self.documents - k)[self.documents - k]))
            rest = head.sum()
            waits = rest - spent
            undecided = (waits > 0) & (lower + waits >= proven)
            count = np.count_nonzero(undecided)
            if not count:
                possible = np.flatnonzero(lower >= proven)
                return possible, lower[possible]
            # While unseen documents can still get in, every list is read; then those that an undecided document has not been met in.
            wanted = head > 0
            if rest < proven:
                for i in np.flatnonzero(wanted):
                    wanted[i] = np.count_nonzero(undecided[lists[i][0][: read[i]]]) < count


class Best:
    """The k best documents of each query so far, by score, then by id (null first)."""

    def __init__(self, k: int, proven: dict[int, int]):
        self.k, self.proven, self.found = k, dict(proven), {}

    def add(self, item: int, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        if item in self.found:
            ids, null, scores = (np.concatenate(c) for c in zip(self.found[item], (ids, null, scores), strict=True))
        order = np.lexsort((ids, ~null, -scores))[: self.k]
        self.found[item] = ids[order], null[order], scores[order]
        if len(order) == self.k:
            self.proven[item] = max(self.proven.get(item, 0), int(scores[order[-1]]))


def shards(batches, documents: int, length: int):
    """(ids, whether null, shard) of pieces of a partition of bounded size."""
    held, docs, postings = [], 0, 0

    def built():
        table = pa.Table.from_batches(held).combine_chunks()
        ids, n, terms, times = (c.combine_chunks() for c in table.columns)
        sizes = np.diff(terms.offsets.to_numpy())
        shard = Shard(n.to_numpy(), sizes, terms.flatten().to_numpy(), times.flatten().to_numpy(), documents, length)
        return pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), shard

    for batch in slices(batches, SHARD_DOCS // 16):
        if held and (docs + batch.num_rows > SHARD_DOCS or postings > SHARD_POSTINGS):
            yield built()
            held, docs, postings = [], 0, 0
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column(2).flatten())
    if docs:
        yield built()


def searched(rows: DataFrame, queries, documents: int, length: int, k: int, proven: dict[int, int]) -> DataFrame:
    """(item_id, doc_id, score): the k best of each partition, as far as they reach what is proven.

    queries: broadcast list of (item_id, term numbers, weights).
    """
    known = rows.sparkSession.sparkContext.broadcast(proven)
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        best = Best(k, known.value)
        for ids, null, shard in shards(batches, documents, length):
            for item, terms, weights in queries.value:
                at, scores = shard.search(terms, weights, k, best.proven.get(item, 0))
                best.add(item, ids[at], null[at], scores)
        for item, (ids, null, scores) in best.found.items():
            yield batch_of(schema, np.full(len(ids), item), pa.array(ids, pa.int64(), mask=null), scores)

    return rows.mapInArrow(search, "item_id long, doc_id long, score long")


def search_block(docs: DataFrame, asked: dict[int, list[str]], k: int) -> DataFrame:
    """(item_id, doc_id, score), the k best of all documents and some more, for one block of queries."""
    spark = docs.sparkSession
    terms = sorted({t for ts in asked.values() for t in ts})
    rows = written(counted(docs, terms), "counted")
    documents, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(map(tuple, rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
    weights = np.array([weight(documents, holding.get(i, 0)) for i in range(len(terms))], dtype=np.int64)
    number = {t: i for i, t in enumerate(terms)}
    queries = []
    for item in sorted(asked):
        at = np.array(sorted(number[t] for t in asked[item]), dtype=np.int32)
        queries.append((item, at, weights[at]))
    queries = spark.sparkContext.broadcast(queries)
    parts = max(SHARE, -(-documents // FIRST))
    first = searched(rows.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(parts)) == 0), queries, documents, length, k, {})
    proven = ranked(first, k).filter(F.col("rank") == k).select("item_id", "score").collect()
    return searched(rows, queries, documents, length, k, dict(map(tuple, proven)))


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents with a score above 0 for each item; ties go to the smaller doc_id.

    A term is a run of letters and digits of ASCII and of any characters outside ASCII; only A-Z are lower-cased. Each row of docs with a term is
    a document: rows that repeat a doc_id are ranked one by one, and a null doc_id comes before all others. Null, empty and blank texts are no
    documents. Rows of items that repeat an item_id are one query; items without an id or without terms have no rows, nor have any over an empty
    table of documents. Texts are read whole; other columns are ignored.

    Queries are dealt to blocks of about BLOCK pairs of query and term, by their id, and a block's terms are what a task knows; documents are
    read once for each block.
    """
    spark = docs.sparkSession
    pairs = written(query_terms(items), "query_terms")
    blocks = max(1, -(-pairs.count() // BLOCK))
    found = None
    for block in range(blocks):
        asked: dict[int, list[str]] = {}
        for item, term in pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            asked.setdefault(item, []).append(term)
        part = search_block(docs, asked, k) if asked else spark.createDataFrame([], "item_id long, doc_id long, score long")
        found = part if found is None else found.union(part)
    removed(pairs)
    return ranked(found, k).select("item_id", "rank", "doc_id", "score")
