"""Byte-level BPE encoding and decoding (operator 7) as a monoid over a tree of text halves.

The element of a span of text is the token ids of that span taken alone. `encode` halves a text until a leaf is short,
encodes leaves and joins neighbours. A join re-encodes a window around the seam that grows, on each side, until its edge
is at a sure place or at the end of the span. A place is sure if a match of the pattern ends there whatever stands around:
before white space that follows another character, and between a letter and an ASCII punctuation mark. Matches on either
side of a sure place do not see each other, so tokens outside the window cannot change. Decoding joins bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, slices, text_of, with_texts

#: Characters of a leaf; first width of a window on each side of a seam.
LEAF, WINDOW = 2048, 16


@lru_cache(4)
def encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def is_sure(text: str, i: int) -> bool:
    before, after = text[i - 1], text[i]
    if after in " \n\t":
        return not before.isspace()
    return before.isascii() and before.isalpha() and after in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class Tree:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: str, pattern: str, leaf: int = LEAF):
        self.bpe, self.leaf = encoding(ranks, pattern), leaf
        self.bytes_of = {rank: token for token, rank in self.bpe._mergeable_ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b, width = mid, mid, WINDOW
        while a > lo:
            a = next((i for i in range(a - 1, max(lo, mid - width), -1) if is_sure(text, i)), -1)
            if a >= 0:
                break
            a = max(lo, mid - width)
            width *= 2
        width = WINDOW
        while b < hi:
            b = next((i for i in range(b + 1, min(hi, mid + width)) if is_sure(text, i)), -1)
            if b >= 0:
                break
            b = min(hi, mid + width)
            width *= 2
        kept = self._tail(left, len(text[a:mid].encode()))
        gone = self._head(right, len(text[mid:b].encode()))
        return left[: len(left) - kept] + self.bpe.encode_ordinary(text[a:b]) + right[gone:]

    def _tail(self, ids: list[int], size: int) -> int:
        """How many of the last ids make up so many bytes."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        return n

    def _head(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[n]])
            n += 1
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def tree(ranks: str, pattern: str) -> Tree:
    return Tree(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *keep: str) -> DataFrame:
    """Per row of docs: `row`, a struct of the columns named in keep, and `ids` (array of int), the text's token ids.

    Null and empty texts have no ids. Repeated rows are each returned; other columns are ignored; texts are encoded whole; an empty
    table gives an empty result.
    """
    rows = with_texts(docs, F.struct(*keep).alias("row"), keep)

    def run(batches):
        encode = tree(ranks, pattern).encode
        for batch in slices(batches):
            ids = pa.array([encode(t or "") for t in text_of(batch).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["row", "ids"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encoded(row, ids) with `decoded` (binary), the bytes of the ids; null ids give null, no ids give no bytes.

    Rows that are repeated are each decoded; an empty table gives an empty result; lists of any length are decoded whole.
    """
    rows = encoded.select("row", "ids")

    def run(batches):
        decode = tree(ranks, pattern).decode
        for batch in slices(batches):
            found = pa.array([None if i is None else decode(i) for i in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["row", "ids", "decoded"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trips(docs: DataFrame, ranks: str, pattern: str, *keep: str) -> DataFrame:
    """`encode_documents` with `round_trip`: whether decoding the ids gives the text's bytes back.

    Both are one pass: two would hold two workers a core, each with its own tables, and the decoded bytes would travel.
    """
    rows = with_texts(docs, F.struct(*keep).alias("row"), keep)

    def run(batches):
        codec = tree(ranks, pattern)
        for batch in slices(batches):
            texts = [t or "" for t in text_of(batch).to_pylist()]
            found = [codec.encode(t) for t in texts]
            same = [codec.decode(ids) == t.encode() for ids, t in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["row", "ids", "round_trip"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, round_trip boolean")


def bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Encoding and decoding share a pass, so that ids need not travel between Python and the JVM twice. Null and empty
    texts have 0 tokens and the digests of no bytes. Repeated rows are each returned; a null doc_id is returned as null; other columns are
    ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = tree(ranks, pattern)
        for batch in slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                found.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield batch_of(schema, batch.column(0), *([x[i] for x in found] for i in range(3)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
