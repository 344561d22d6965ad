"""Substring deduplication (operator 2): seed and extend.

A window is SPAN consecutive words; it is removed if the same words start earlier (smaller doc_id, or same row, earlier).

1. Seeds. The anchor of a window is the smallest hash of its GRAM-word runs (winnowing), so equal windows have equal
   anchors at equal offsets, and every window belongs to exactly one anchor. An anchor stands for a run of neighbouring windows.
2. Join. Anchors meet by hash. Within an Arrow batch only the first of equal ones is sent, so a passage that fills a third
   of the corpus weighs one row a batch. Where a batch holds one anchor in many stretches, as a phrase of GRAM words in a third
   of all documents does, two of them are sent under the anchor, which tells all others of that anchor that it has more than one
   stretch; the rest need not meet anyone to be extended, and go under keys of their own.
3. Extend. Each anchor carries a hash of its whole stretch, the words that its windows cover to the left and right. Equal
   stretches repeat as a whole. Where the stretches of one anchor differ, the first row of each is extended word by word:
   its windows are compared one by one by a 128-bit hash. Pairs of documents are never formed: n stretches of an anchor would
   make n * n / 2 extensions, while the windows to the left and right of an anchor are at most RUNS a stretch.
4. Overlapping repeated windows merge into maximal repeats, at least SPAN words long, and their words go.

Rows are told apart by doc_id and a hash of the text: rows that repeat a doc_id are not earlier than each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, in_batches, mix, runs_hash, signed, slices, text_of, word_hashes, written

SPAN, GRAM = 20, 6
#: GRAM-word runs in a window.
RUNS = SPAN - GRAM + 1
#: An odd factor and its inverse modulo 2**64, for hashes of stretches of any length from prefix sums.
FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 2**64)
#: Documents whose anchors are made unique together; it bounds a worker's memory, not the result.
TOGETHER = 4096

KEYED = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("row", pa.int32()), ("at", pa.int64())])
KEYED_SQL = "kind int, k1 long, k2 long, doc long, row int, at long"
#: Kinds of rows: to be compared by key, known to repeat an earlier one, and known to be one of several stretches of an anchor.
OPEN, REPEAT, EXTEND = 0, 1, 2
#: Stretches of one anchor that a batch sends under the anchor's hash: as many as it takes to tell that there are several.
MEET = 2


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)


def anchors(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """From word hashes: anchor hash, stretch hash, first window, and number of further windows, for each anchor."""
    grams = runs_hash(h, GRAM, 1)
    n = len(h) - SPAN + 1
    chosen = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, RUNS).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    more = np.diff(np.r_[first, n]) - 1
    place, last = chosen[first], first + more
    sums = np.r_[np.uint64(0), np.cumsum(h * _powers(FACTOR, len(h) - 1), dtype=np.uint64)]
    stretch = (sums[last + SPAN] - sums[first]) * _powers(INVERSE, n)[first]
    shape = ((place - first) * RUNS + more).astype(np.uint64)
    return grams[place], mix(stretch ^ mix(shape + np.uint64(1))), first, more


def windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that anchors stand for: two hashes of their words, and where they start. at: first * 16 + more."""
    first, more = at >> 4, at & 15
    start = np.repeat(first, more + 1) + np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return runs_hash(h, SPAN, 2)[start], runs_hash(h, SPAN, 3)[start], start


def _first_only(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, meet: int | None) -> pa.RecordBatch:
    """Rows of one batch: of those with equal keys only the first stays OPEN; keys of the others are spread out.

    With meet, no more than so many different k2 of a k1 stay OPEN; the first rows of further ones become EXTEND and are spread out too.

    Rows that are equal in everything are sent once: marks return by (doc, row), so one stands for all of them.
    """
    order = np.lexsort((at, row, doc, k2, k1))
    k1, k2, doc, row, at = k1[order], k2[order], doc[order], row[order], at[order]
    equal = lambda *columns: np.r_[False, np.logical_and.reduce([c[1:] == c[:-1] for c in columns])][: len(k1)]
    new = ~equal(k1, k2, doc, row, at)
    k1, k2, doc, row, at = k1[new], k2[new], doc[new], row[new], at[new]
    # Earlier is a smaller doc_id or, in the same row, a smaller place; another row with the same doc_id is not.
    same, again = equal(k1, k2), equal(k1, k2, doc, row)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k1))))
    again |= doc > doc[head]
    kind = np.where(again, REPEAT, OPEN)
    if meet is not None:
        stretch = np.cumsum(~same)
        nth = stretch - stretch[np.maximum.accumulate(np.where(equal(k1), 0, np.arange(len(k1))))]
        kind = np.where(~again & (nth >= meet), EXTEND, kind)
    k1 = np.where(kind == OPEN, k1, mix(k1 ^ mix(doc.view(np.uint64) * np.uint64(31) + at.view(np.uint64))))
    return batch_of(KEYED, kind.astype(np.int32), signed(k1), signed(k2), doc, row, at)


def _gathered(parts: list[tuple], meet: int | None = None) -> pa.RecordBatch:
    """parts: (k1, k2, at, doc, row) of each document."""
    size = [len(p[0]) for p in parts]
    join = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind, copy=False) if parts else np.zeros(0, dtype=kind)
    doc, row = np.repeat(np.array([p[3] for p in parts], dtype=np.int64), size), np.repeat(np.array([p[4] for p in parts], dtype=np.int32), size)
    return _first_only(join(0, np.uint64), join(1, np.uint64), doc, row, join(2, np.int64), meet)


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc: doc_id, with null last; row: 31 bits of a hash of the text; text: bytes."""
    last = F.lit(2**63 - 1)
    return in_batches(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.xxhash64("text").bitwiseAND(2**31 - 1).cast("int").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *more
    )


def _anchors_of(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, TOGETHER):
            parts = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().split()
                if len(words) >= SPAN:
                    gram, stretch, first, more = anchors(word_hashes(words))
                    parts.append((gram, stretch, first * 16 + more, doc, row))
            yield _gathered(parts, MEET)

    return rows.select("doc", "row", "text").mapInArrow(run, KEYED_SQL)


def _windows_of(rows: DataFrame) -> DataFrame:
    """rows with `ats`, the anchors to extend: their windows, keyed by the words' hashes."""

    def run(batches):
        for batch in slices(batches, TOGETHER):
            parts = []
            for doc, row, text, ats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                w1, w2, start = windows(word_hashes(text.as_py().split()), np.sort(ats.values.to_numpy()))
                parts.append((w1, w2, start * 16, doc, row))
            yield _gathered(parts)

    return rows.select("doc", "row", "text", "ats").mapInArrow(run, KEYED_SQL)


def _compared(keyed: DataFrame, *more: Column) -> DataFrame:
    """keyed rows with `first`, the smallest doc of the same key, and what else is asked for."""
    return keyed.withColumn("first", F.min("doc").over(Window.partitionBy("k1", "k2"))).withColumns({f"m{i}": c for i, c in enumerate(more)})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Runs of windows that start earlier as well: doc, row and `ats`, an array of first * 16 + number of further windows."""
    rows = _rows(docs)
    by_anchor = Window.partitionBy("k1")
    seen = _compared(_anchors_of(rows), F.min("k2").over(by_anchor), F.max("k2").over(by_anchor))
    seen = seen.withColumn("repeat", (F.col("kind") == REPEAT) | (F.col("doc") > F.col("first")))
    marks = written(seen.filter((F.col("kind") == EXTEND) | F.expr("repeat or m0 <> m1")).select("doc", "row", "at", "repeat"), "anchors")
    extend = marks.filter("not repeat").groupBy("doc", "row").agg(F.collect_set("at").alias("ats"))
    found = _compared(_windows_of(rows.join(extend.hint("shuffle_hash"), ["doc", "row"])))
    found = found.filter((F.col("kind") == REPEAT) | (F.col("doc") > F.col("first"))).select("doc", "row", "at")
    return marks.filter("repeat").select("doc", "row", "at").union(found).groupBy("doc", "row").agg(F.collect_set("at").alias("ats"))


def merged(ats: np.ndarray) -> list[tuple[int, int]]:
    """Maximal repeats, as word offsets [start, end)."""
    spans: list[list[int]] = []
    for at in np.sort(ats).tolist():
        start, end = at >> 4, (at >> 4) + (at & 15) + SPAN
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def without_repeats(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs: `row`, a struct of the columns named in keep, n_words, n_removed, spans (maximal repeats, word offsets), kept (text).

    A null text has no words and keeps the empty text. Rows with a null doc_id come after all others and never remove each
    other's words. Rows that repeat a doc_id do not remove each other's words. Other columns are ignored; texts are compared
    whole; an empty table gives an empty result.
    """
    rows = _rows(docs, F.struct(*keep).alias("keep"))
    kept_type = rows.schema["keep"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, ats in zip(text_of(batch.drop_columns("ats")).cast(pa.binary()), batch.column("ats"), strict=True):
                words = (text.as_py() or b"").split()
                spans = merged(ats.values.to_numpy()) if ats.is_valid else []
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), spans, b" ".join(kept)))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
            columns.append(pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            columns.append(pa.array([x[3].decode("utf-8", "replace") for x in out], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["keep", "n_words", "n_removed", "spans", "kept"])

    joined = rows.join(repeated_windows(docs).hint("shuffle_hash"), ["doc", "row"], "left").select("keep", *([] if "text" in keep else ["text"]), "ats")
    done = joined.mapInArrow(run, f"keep {kept_type}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return done.withColumnRenamed("keep", "row")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    done = without_repeats(docs, "doc_id")
    return done.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
