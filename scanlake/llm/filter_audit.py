"""Filter interaction audit (operator 12): what each filter removes in every order of filters, from min-plus removal ranks.

Each document becomes the set of filters that it fails, a bit mask. Masks are counted by Spark, so what is left of a part is one
number for each mask at most. A mask is a row of zeros (fails) and infinities (passes); an order is the row of the filters' places in it, the inverse of
the permutation. The min-plus product of the two matrices is the step at which each order removes each mask. Counts are scattered to those steps.

Exact copies are found by digests: rows are counted by digest and doc_id, then by digest and mask, before any table is joined on a digest.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, removed, slices, written

#: The filters of `document_failures` and of copies, in the order of their bits.
LETTERS = "ABCDE"
#: A: fewer words than this. B: distinct words under this share of words. C: capitals over this share of code points, in hundredths. D: any of these.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
TOGETHER = 64


def sums_by_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[ends[1:]] - total[ends[:-1]]


def failures_of(texts: pa.Array) -> np.ndarray:
    """The filters A to D that texts (strings without nulls) fail, as bits 1, 2, 4 and 8."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    lists = pc.ascii_split_whitespace(texts)
    words, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    words, row = words.filter(some).dictionary_encode(), row[some.to_numpy(zero_copy_only=False)]
    n = np.bincount(row, minlength=len(texts))
    vocabulary = max(1, len(words.dictionary))
    distinct = np.bincount(np.unique(row * vocabulary + words.indices.to_numpy()) // vocabulary, minlength=len(texts))
    capitals = sums_by_text((data >= ord("A")) & (data <= ord("Z")), ends)
    points = sums_by_text((data & 0xC0) != 0x80, ends)
    symbols = sums_by_text(np.isin(data, np.frombuffer(SYMBOLS, dtype=np.uint8)), ends)
    return (n < LEAST_WORDS) + 2 * (100 * distinct < DISTINCT * n) + 4 * (100 * capitals > CAPITALS * points) + 8 * (symbols > 0)


def document_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, failed) of each row: part is its source (null: empty string), failed has the bits of A to D; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("failed", pa.int32())])

    def read(batches):
        for batch in slices(batches, TOGETHER):
            digests = [hashlib.blake2b(t.as_buffer(), digest_size=24).digest() for t in batch.column(2).cast(pa.binary())]
            yield batch_of(schema, batch.column(0), batch.column(1), digests, failures_of(batch.column(2)).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(read, "doc_id long, part string, digest binary, failed int")


def labelled(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `document_failures` counted by all their columns, with good and toxic from the labels of their doc_id.

    Of labels that repeat a doc_id any 1 counts. Rows without a doc_id have no labels; they are dealt by their digest, so that they are no one task.
    """
    fine = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    fine = fine.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("dealt", F.lit(0).cast("long"))
    rows = failures.withColumn("dealt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(fine.hint("merge"), ["doc_id", "dealt"], "left").fillna(0, ["good", "toxic"])
    return rows.groupBy("doc_id", "dealt", "digest", "part", "failed", "good", "toxic").agg(F.count("*").alias("n"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(part, failed, n, good, toxic) from counted rows: those whose digest a smaller doc_id has fail the filter of this bit too.

    Rows with the smallest doc_id of a digest and rows without a doc_id do not fail it.
    """
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    cells = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(own).alias("own"))
    cells = cells.join(first.hint("merge"), "digest", "left")
    kept = F.col("nameless") + F.when(F.col("own.doc_id") == F.col("first"), F.col("own.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("failed"), kept.alias("n")), F.struct((F.col("failed") + bit).alias("failed"), (F.col("n") - kept).alias("n"))))
    cells = cells.select("part", both.alias("cell"), "good", "toxic").select("part", "cell.failed", F.col("cell.n").alias("n"), "good", "toxic")
    return cells.groupBy("part", "failed").agg(*[F.sum(v).alias(c) for c, v in (("n", F.col("n")), ("good", F.col("n") * F.col("good")), ("toxic", F.col("n") * F.col("toxic")))])


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of so many filters, and the step (from 0) at which each (columns) removes each mask (rows); masks that pass: `filters`."""
    orders = np.array(list(permutations(range(filters))))
    place = np.argsort(orders, axis=1)
    fails = np.where(np.arange(1 << filters)[:, None] >> np.arange(filters) & 1, 0, filters)
    return orders, (fails[:, None, :] + place[None]).min(axis=2).clip(max=filters)


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each step of each order of the filters does to each part.

    masks: (part, failed, n, good, toxic), each part and bit mask once. For each part and order: filter_order, step (from 1), and counts of documents: kept
    after the step, removed by it, redundant (fail its filter, removed before), unique_fails (fail its filter alone), good_lost and toxic_lost (removed
    here), and shapley (what its filter removes, over all orders). Zeros are rows too; no masks give no rows. A part is one small row: its masks.
    """
    filters = len(letters)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])

    def expand(batches):
        orders, removed_at = removal_steps(filters)
        names, slot = ["".join(letters[f] for f in o) for o in orders], np.arange(len(orders)) * (filters + 1)
        has = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
        for batch in slices(batches, 16):
            parts = batch.num_rows
            count = np.zeros((3, parts, 1 << filters), dtype=np.int64)
            for p, cells in enumerate(batch.column(1).to_pylist()):
                for cell in cells:
                    count[:, p, cell["failed"]] = cell["n"], cell["good"], cell["toxic"]
            gone = np.zeros((3, parts, len(orders) * (filters + 1)), dtype=np.int64)
            redundant = np.zeros((parts, len(orders), filters), dtype=np.int64)
            for mask, at in enumerate(removed_at):
                gone[:, :, slot + at] += count[:, :, mask, None]
                later = has[mask][orders] * (np.arange(filters) > at[:, None])
                redundant += count[0][:, mask, None, None] * later
            n, good, toxic = gone.reshape(3, parts, len(orders), filters + 1)[..., :filters]
            kept = count[0].sum(axis=1)[:, None, None] - np.cumsum(n, axis=2)
            alone = count[0][:, 1 << np.arange(filters)]
            shapley = np.zeros((parts, filters), dtype=np.int64)
            for f in range(filters):
                shapley[:, f] = np.where(orders == f, n, 0).sum(axis=(1, 2))
            rows = len(orders) * filters
            yield batch_of(
                schema, batch.column(0).take(pa.array(np.repeat(np.arange(parts), rows))), np.tile(np.repeat(names, filters), parts), np.tile(np.arange(1, filters + 1, dtype=np.int32), parts * len(orders)),
                *(c.ravel() for c in (kept, n, redundant, alone[:, orders], good, toxic, shapley[:, orders])),
            )

    rows = masks.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    return rows.mapInArrow(expand, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'long'}" for f in schema))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of five filters over whole texts, for each source; see `interactions` for the columns.

    A: under 200 words; B: under half of the words distinct; C: over 2 % of code points in A-Z; D: any of # $ % & * |; E: a row with a smaller
    doc_id has the same text. A null text is empty (and empty texts are copies of each other), a null source the empty string. A row without
    a doc_id is no copy and makes none; rows that repeat a doc_id count one by one and are no copies of each other. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = written(labelled(document_failures(docs), labels), "failures")
    masks = written(with_copies(rows, 1 << LETTERS.index("E")), "masks")
    removed(rows)
    return interactions(masks)
