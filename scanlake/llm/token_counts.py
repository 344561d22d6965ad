"""Token counts (operator 1): a map-side lookup in two tiers.

Tier one is a bounded table of frequent pre-tokens and their token counts, broadcast once. Tier two is a cache in each
Python worker that the sentencepiece library fills on a miss. Texts stay in their partition and no pre-token is shuffled. Some texts are
taken together: their pre-tokens are numbered by Arrow, and each distinct one is looked up once.

A pre-token starts at a run of spaces or at a line feed. No piece of the vocabulary has a space after another character
and none has a line feed, so no merge crosses these places and counts add up; `check_pieces` refuses other models. For the same
reason distinct pre-tokens are cut once more, between characters that stand side by side in no piece (a letter and a full stop,
say): what is looked up and encoded are these parts, which repeat more often.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import CACHE, batch_of, slices
from scanlake.llm.words import bytes_of

#: How sentencepiece writes a space.
SPACE = "▁"

#: What a model that changes characters would change: accents and ligatures to compose, wide letters, control characters.
UNCHANGED = "e\u0301\uff21\ufb01\u2126\u00ad\u200b\u00a0\x00\x07\tAB"

_processors: dict = {}


def processor(model: str) -> tuple:
    """The library's model, and where its texts may be cut (see `seams`)."""
    if model not in _processors:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        check_pieces(sp)
        _processors[model] = sp, seams(sp)
    return _processors[model]


def check_pieces(sp) -> None:
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or sp.encode("  a ", out_type=str)[-1] != SPACE or sp.normalize(UNCHANGED) != SPACE + UNCHANGED:
        raise ValueError("pre-tokens of this model cannot be counted one by one")


def seams(sp) -> np.ndarray:
    """For 256 * a + b: whether texts may be cut between bytes a and b, as they end and begin characters that stand side by side in no piece."""
    apart = np.ones((256, 256), dtype=bool)
    apart[:, 0x80:0xC0] = False  # inside a character
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i).replace(SPACE, " ")
        for a, b in zip(piece, piece[1:], strict=False):
            apart[a.encode()[-1], b.encode()[0]] = False
    return apart.ravel()


def parts(pieces: pa.Array, apart: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of pre-tokens, cut at seams, and the pre-token that each belongs to."""
    if not len(pieces):
        return pieces, np.zeros(0, dtype=np.int64)
    ends, data = bytes_of(pieces)
    first = np.zeros(len(data), dtype=bool)
    first[ends[:-1]] = True
    at = np.flatnonzero(first | np.r_[False, apart[(data[:-1].astype(np.uint16) << 8) | data[1:]]])
    cuts = np.r_[at, len(data)].astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(data)), np.cumsum(first[at]) - 1


class Counts(dict):
    """Part of a pre-token to its number of tokens: frequent ones from the start, others as they are met."""

    def __init__(self, model: str, frequent: dict[str, int]):
        super().__init__(frequent)
        sp, self.apart = processor(model)
        self.frequent, self.encode = frequent, sp.encode

    def __missing__(self, key: str) -> int:
        return self.met([key])[0]

    def met(self, keys: list[str]) -> list[int]:
        """The tokens of parts that are not in the table, encoded together; as many as it holds are remembered."""
        if len(self) + len(keys) > CACHE:
            self.clear()
            self.update(self.frequent)
        # The library puts one SPACE before each text; "\n" keeps it apart from what follows.
        found = self.encode([k[1:] if k[0] == SPACE else "\n" + k for k in keys], num_threads=1) if keys else []
        sizes = [len(ids) or 1 if k[0] == SPACE else len(ids) - 2 for k, ids in zip(keys, found, strict=True)]
        self.update(zip(keys[: max(0, CACHE - len(self))], sizes, strict=False))
        return sizes

    def of(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text."""
        pieces, doc = pre_tokens(texts)
        return self.of_pieces(pieces.dictionary_encode(), doc, len(texts))

    def of_pieces(self, found: pa.DictionaryArray, doc: np.ndarray, texts: int) -> np.ndarray:
        """The tokens of each of so many texts, from their numbered pre-tokens."""
        pieces, piece = parts(found.dictionary, self.apart)
        pieces = pieces.dictionary_encode()
        distinct = pc.replace_substring(pieces.dictionary, " ", SPACE).to_numpy(zero_copy_only=False).tolist()
        n = list(map(self.get, distinct))
        missing = [i for i, known in enumerate(n) if known is None]
        for i, size in zip(missing, self.met([distinct[i] for i in missing]), strict=True):
            n[i] = size
        n = np.bincount(piece, weights=np.array(n, dtype=np.int64)[pieces.indices.to_numpy()], minlength=len(found.dictionary)) if len(piece) else np.zeros(0)
        return np.bincount(doc, weights=n[found.indices.to_numpy()], minlength=texts).astype(np.int64) if len(doc) else np.zeros(texts, dtype=np.int64)


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of texts, each text with a space before it, and the text that each belongs to. Null and empty texts have none."""
    some = np.flatnonzero(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False))
    if not len(some):
        return pa.array([], pa.string()), some
    # The mark that the library writes for a space counts as one in a text as well.
    spaced = pc.replace_substring(pc.binary_join_element_wise("", texts.take(pa.array(some)), " "), SPACE, " ")
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    first = np.zeros(len(data), dtype=bool)
    first[ends[:-1] - ends[0]] = True
    is_space = data == 32
    at = np.flatnonzero(first | (data == 10) | (is_space & ~np.r_[False, is_space[:-1]]))
    cuts = np.r_[at, len(data)].astype(np.int32)
    doc = some[np.cumsum(first[at]) - 1]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(data)), doc


#: Texts of a batch that are cut together.
TOGETHER = 64


def frequent_pre_tokens(docs: DataFrame, model: str, entries: int = 65_536, sample_rows: int = 8_192, longest: int = 32) -> dict[str, int]:
    """The table of tier one: at most `entries` parts of pre-tokens, of at most `longest` bytes, from about `sample_rows` rows, counted within tasks first.

    The sample only decides what is looked up fast; counts are the same with any table, so the bound holds at any size.
    """

    def count(batches):
        seen, (_, apart) = Counter(), processor(model)
        for batch in slices(batches, TOGETHER):
            pieces, _ = parts(pre_tokens(batch.column(0))[0], apart)
            found = pc.value_counts(pieces.filter(pc.less_equal(pc.binary_length(pieces), longest)))
            seen.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            if len(seen) > 16 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(2 * entries)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["k", "seen"])

    def counted(batches):
        counts = Counts(model, {})
        for batch in batches:
            keys = pc.replace_substring(batch.column(0), " ", SPACE).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts.met(keys), pa.int32())], names=["k", "n"])

    rows = docs.select("text").filter("text is not null and text <> ''")
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = rows.sample(share, seed=1) if share < 1 else rows
    top = rows.mapInArrow(count, "k string, seen long").groupBy("k").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "k").limit(entries)
    return dict(map(tuple, top.select("k").mapInArrow(counted, "k string, n int").collect()))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, frequent: dict[str, int] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens without begin and end tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id is returned as null; repeated rows are each returned;
    other columns are ignored. Texts of any length are counted whole; an empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, model) if frequent is None else frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        counts = Counts(model, table.value)
        for batch in slices(batches, TOGETHER):
            yield batch_of(schema, batch.column(0), batch.column(2), counts.of(batch.column(1)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
