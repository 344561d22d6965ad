"""Words of texts as Arrow arrays: cut, hashed and numbered without an object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scanlake.llm.common import mix


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the bytes of an Arrow array of words, and the end; and the bytes."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return ends - ends[0], np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """The sizes of words as 32-bit integers, and their bytes: two values, which Spark moves as they are, in place of one for each word."""
    ends, data = bytes_of(words)
    return np.diff(ends).astype("<i4").tobytes(), data.tobytes()


def unpacked_words(sizes: bytes, data: bytes) -> pa.Array:
    ends = np.r_[0, np.cumsum(np.frombuffer(sizes, dtype="<i4"), dtype=np.int64)].astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))


def word_hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, the same for equal words everywhere; for dealing, not for telling words apart."""
    ends, data = bytes_of(words)
    size = np.diff(ends)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0xD1342543DE82EF95, dtype=np.uint64), dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], size)], dtype=np.uint64)]
    return mix(sums[ends[1:]] - sums[ends[:-1]])


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in lower case, and an empty word at the end of each text; and how many there are in each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    # What stands at either end of a text is an empty piece if there is white space, and so is a text without words.
    words, doc = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(some)), doc[some]
    words = pa.concat_arrays([words, pa.array([""], words.type)])
    lengths = np.bincount(doc, minlength=len(lists)) + 1
    at = np.full(lengths.sum(), len(words) - 1)
    inside = np.ones(len(at), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    at[inside] = np.arange(len(words) - 1)
    return words.take(pa.array(at)), lengths
