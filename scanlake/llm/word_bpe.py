"""Word-level BPE encoding and decoding (operator 13) by a backtracking encoder.

A pre-token is a string of symbols, the last of which is marked as the word's end. An Aho-Corasick automaton over the tokens gives the longest
token that starts at a place. The encoder takes that token if it is compatible with the token before it, else the next shorter prefix that is a
token, else it steps back and marks the place as one that nothing leads on from. Two tokens are compatible if applying the merges to their
symbols gives just these two, which a table of pairs remembers. A row of pairwise compatible tokens is what the merges give, so ids are
exact; a place is given up once at most, so the time is linear in the symbols. Decoding reads an offset table.

Texts are cut into pieces without an object for each: pre-tokens of words of printable ASCII, in lower case, and other words whole. Each distinct
piece of a batch is encoded once, and remembered. Other words are cleaned and split by the tokenizers library as the file says (it merges
nothing here); neither looks across ASCII white space.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import CACHE, batch_of, slices

#: How the file marks a word's end, and what is added to a symbol's code point for it here.
END, LAST = "</w>", 1 << 12
#: Pairs of tokens that a worker's table may hold; texts of a batch whose words are numbered together; ids that are written out together.
PAIRS, TOGETHER, AT_ONCE = 1 << 20, 256, 1 << 18
#: The parts of a file that a tokenizer must share with this module.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a byte is: white space, a letter, a digit, another printable character of ASCII, or something else.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.array([SPACE if b in b" \t\n\v\f\r" else OTHER if b < 33 or b > 126 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN for b in range(256)], dtype=np.uint8)
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts (strings without nulls) and the text that each belongs to.

    A piece is a pre-token in lower case if its word is of printable ASCII and has no "<|", with which special tokens begin, and else the word as it is.
    """
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends, n = ends - ends[0], len(data)
    first = np.zeros(n + 3, dtype=bool)
    first[ends] = True
    first[n:] = True
    kind, low = KIND[data], np.r_[LOWER[data], np.zeros(3, np.uint8)]
    filled = kind != SPACE
    word = filled & (first[:n] | np.r_[True, ~filled[:-1]][:n])
    number = np.cumsum(word) - 1
    special = (low[:n] == ord("<")) & (low[1 : n + 1] == ord("|")) & ~first[1 : n + 1]
    odd = np.zeros(n, dtype=bool)
    if word.any():
        odd = (np.bincount(number[(kind == OTHER) | special], minlength=number[-1] + 1) > 0)[number] & filled
    start = word | (filled & ~odd & ((kind == DIGIT) | (kind != np.r_[kind[:1], kind[:-1]])))
    # A quotation mark that begins a piece takes some letters with it, and what follows these begins another.
    mark = np.flatnonzero((low[:n] == ord("'")) & start & ~odd)
    mark = mark[~first[mark + 1]]
    one, two = low[mark + 1], low[mark + 2]
    longer = ~first[mark + 2] & (((two == ord("e")) & np.isin(one, (ord("r"), ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
    taken = longer | np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    start[mark[taken] + 1] = False
    after = (mark + 2 + longer)[taken]
    after = after[after < n]
    start[after[filled[after]]] = True
    at = np.flatnonzero(start)
    cuts = np.r_[np.cumsum(filled)[at] - 1, np.count_nonzero(filled)].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(np.where(odd, data, low[:n])[filled]))
    return pieces, np.searchsorted(ends, at, side="right") - 1


class Compatible(dict):
    """(token, next token) to whether merging their symbols leaves the seam alone; pairs are worked out as they are met."""

    def __init__(self, merges: dict[tuple[int, int], int], left: list[int], right: list[int], symbols: int):
        super().__init__()
        self.merges, self.left, self.right, self.symbols = merges, left, right, symbols

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        found = self[pair] = self.untouched(*pair, len(self.left))
        return found

    def untouched(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge with an id below `limit` crosses the seam of a and b. Ids are in the order of merges.

        Merges are undone from the last one back, on whichever side it was. While they stand undone, the tokens at the seam are those that
        were there just before; a merge of these two that comes earlier would have been made. Of equal merges the left one comes first.
        """
        while True:
            if self.merges.get((a, b), limit) < limit:
                return False
            if a > b and a >= self.symbols:
                limit, a = a, self.right[a]
            elif b >= self.symbols and b >= a:
                limit, b = b + 1, self.left[b]
            else:
                return True


class Encoder:
    """Words to ids and back for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self._check(told)
        library = Tokenizer.from_file(path)
        self._clean, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model, added = told["model"], {t["content"]: t["id"] for t in told["added_tokens"]}
        self.added = added
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        first = len(ids) - len(pairs)
        if any(ids[a + b] != first + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("ids of this vocabulary are not in the order of its merges")
        left, right, symbols = list(range(len(ids))), list(range(len(ids))), [""] * len(ids)
        for text, i in ids.items():
            if i < first:
                symbols[i] = chr(ord(text[0]) + LAST) if text != END and text.endswith(END) else text
        for i, (a, b) in enumerate(pairs, first):
            left[i], right[i] = ids[a], ids[b]
            symbols[i] = symbols[ids[a]] + symbols[ids[b]]
        self.compatible = Compatible({(left[i], right[i]): i for i in range(first, len(ids))}, left, right, first)
        made = [i < first for i in range(len(ids))]  # tokens that merging their own symbols gives
        for i in range(first, len(ids)):
            made[i] = made[left[i]] and made[right[i]] and self.compatible.untouched(left[i], right[i], i)
        token = {s: i for i, s in enumerate(symbols) if made[i]}
        self.size = [len(s) for s in symbols]
        self.shorter = [next((token[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in token), -1) for s in symbols]
        automaton = ahocorasick.Automaton()
        for s, i in token.items():
            automaton.add_word(s, i)
        automaton.make_automaton()
        self.longest = automaton.iter_long  # from a place on: a token begins at each, so the first match is the longest token there
        everything = ids | added
        content = [""] * (max(everything.values()) + 1)
        for text, i in everything.items():
            content[i] = text
        self.contents, self.numbers = OffsetTable(content), OffsetTable(map(str, range(len(content))))
        self.pieces = Pieces(self)

    @staticmethod
    def _check(told: dict) -> None:
        model, split = told["model"], (told["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and model["end_of_word_suffix"] == END
        added = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in told["added_tokens"])
        words = [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["invert"] and split[0]["behavior"] == "Removed" and split[0]["pattern"] == {"Regex": PATTERN} and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        if not (plain and added and words) or told["normalizer"].get("normalizers") != NORMALIZERS or told["decoder"] or told["post_processor"]:
            raise ValueError("words of this tokenizer cannot be encoded one by one")

    def merge(self, pre_token: str) -> list[int]:
        """The ids of one pre-token, given in the characters that stand for bytes."""
        symbols = pre_token[:-1] + chr(ord(pre_token[-1]) + LAST)
        longest, size, shorter, compatible = self.longest, self.size, self.shorter, self.compatible
        n, at, ids, closed = len(symbols), 0, [], set()
        _, token = next(longest(symbols))
        while True:
            end = at + size[token]
            if end not in closed and (not ids or compatible[ids[-1], token]):
                ids.append(token)
                if end == n:
                    return ids
                at = end
                _, token = next(longest(symbols, at))
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = ids.pop()  # its end is closed now, so a shorter one follows
                at -= size[token]

    def word(self, word: str) -> list[int]:
        """The ids of a piece of text without ASCII white space."""
        ids, at = [], 0
        for special in self._added.finditer(word) if self._added else ():
            ids += self._plain(word[at : special.start()])
            ids.append(self.added[special.group()])
            at = special.end()
        return ids + self._plain(word[at:])

    def _plain(self, text: str) -> list[int]:
        return [i for piece, _ in self._split(self._clean(text)) for i in self.merge(piece)] if text else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many belong to each. Null and empty texts have none."""
        pieces, doc = pieces_of(pc.fill_null(texts, ""))
        if not len(pieces):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        found = pieces.dictionary_encode()
        ids = list(map(self.pieces.__getitem__, found.dictionary.to_pylist()))
        at, size = found.indices.to_numpy(), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        start, flat = np.cumsum(size) - size, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=size.sum())
        return gathered(flat, start[at], size[at]), np.bincount(doc, weights=size[at], minlength=len(texts)).astype(np.int64)


class Pieces(dict):
    """Pieces of texts to their ids, as they are met; a full table is emptied."""

    def __init__(self, code: Encoder):
        super().__init__()
        self.merge, self.word = code.merge, code.word

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        plain = piece.isascii() and piece.isprintable() and "<|" not in piece
        found = self[piece] = tuple(self.merge(piece) if plain else self.word(piece))
        return found


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each start and size, one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class OffsetTable:
    """Strings by number: one blob of UTF-8, in which each follows a space, and where each begins and ends."""

    def __init__(self, strings):
        pieces = [b" " + s.encode() for s in strings]
        self.blob, self.ends = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.r_[0, np.cumsum([len(p) for p in pieces])]

    def joined(self, ids: np.ndarray):
        """The strings of the ids joined by spaces, as pieces of bounded size."""
        for at in range(0, len(ids), AT_ONCE):
            some = ids[at : at + AT_ONCE]
            piece = gathered(self.blob, self.ends[some], self.ends[some + 1] - self.ends[some]).tobytes()
            yield piece if at else piece[1:]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Per row of docs: `row`, a struct of the columns named in keep, and `ids` (array of int), the text's token ids.

    path: a vocabulary file of the tokenizers library, on every worker; others than BPE with word ends raise. Strings of special tokens inside a
    text are those tokens, as in the library. Null, empty and blank texts have no ids. Repeated rows are each returned; other columns
    are ignored; texts are encoded whole; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        code = encoder(path)
        for batch in slices(batches, TOGETHER):
            ids, n = code.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "ids"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(row, ids) with `decoded` (string): the tokens' strings joined by spaces, special ones too, as the library decodes where the file names no decoder.

    Null ids give null, no ids an empty string; an empty table gives an empty result; repeated rows are each returned.
    """
    rows = encoded.select("row", "ids")

    def run(batches):
        table = encoder(path).contents
        for batch in slices(batches, TOGETHER):
            found = [None if i is None else b"".join(table.joined(np.array(i, dtype=np.int64))).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["row", "ids", "decoded"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def word_bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (the decoded text in UTF-8).

    Encoding and decoding share a pass, so that ids need not travel between Python and the JVM twice. Null, empty and blank texts have 0 tokens and
    the digests of no bytes. Repeated rows are each returned; a null doc_id is returned as null; other columns are ignored; an empty table
    gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(pieces) -> str:
        sha = hashlib.sha256()
        for piece in pieces:
            sha.update(piece)
        return sha.hexdigest()

    def run(batches):
        code = encoder(path)
        for batch in slices(batches, TOGETHER):
            ids, n = code.encode(batch.column(1))
            each = np.split(ids, np.cumsum(n)[:-1])
            yield batch_of(schema, batch.column(0), n, [digest(code.numbers.joined(i)) for i in each], [digest(code.contents.joined(i)) for i in each])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
