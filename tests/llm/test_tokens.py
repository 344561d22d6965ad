import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scanlake.llm import byte_bpe as B
from scanlake.llm import token_counts as T

MODEL, RANKS, PATTERN = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", "é", "'s", "'", "1", "23", "===", "日", "本", " ", "ing", "The", "▁", "\r", "\t", "\x00", "🙂", "ﷺ", "don't ", "\x1c", "　", "<s>", "<|endoftext|>"]
BPE, SMALL, PIECES, COUNTS = B.encoding(RANKS, PATTERN), B.Tree(RANKS, PATTERN, leaf=8), sentencepiece.SentencePieceProcessor(model_file=MODEL), T.Counts(MODEL, {})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=80).filter(lambda s: s.isascii() or s.encode("utf-8", "ignore").decode() == s))
def test_encoders_equal_the_libraries(text):
    ids = SMALL.encode(text)
    assert ids == BPE.encode_ordinary(text) and SMALL.decode(ids) == text.encode()
    assert COUNTS.of(pa.array([None, text, "", text])).tolist() == [0, len(PIECES.encode(text)), 0, len(PIECES.encode(text))]


def test_texts_without_sure_places():
    for text in ("abcdefgh" * 2000, "=" * 9000, " " * 9000, "日本語" * 3000, "\n" * 5000, "a" * 2047 + " " + "b" * 5000):
        assert B.tree(RANKS, PATTERN).encode(text) == BPE.encode_ordinary(text)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_counts_over_documents(docs):
    want = {r.doc_id: (len(r.text.encode()), len(PIECES.encode(r.text))) for r in docs.collect()}
    for table in (None, {}, {"▁the": 1}):
        got = T.token_counts(docs, MODEL, limit=500, frequent=table).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 500) for r in got)


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 5)
    counts, rnd = T.Counts(MODEL, {"▁the": 1}), random.Random(1)
    for _ in range(50):
        text = " ".join(rnd.choices(["the", "cat", "sat", "on", "a", "mat", "unbelievably"], k=9))
        assert counts.of(pa.array([text]))[0] == len(PIECES.encode(text)) and len(counts) <= 6


def test_bpe_over_documents(docs):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in docs.collect():
        ids = BPE.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(r.text.encode()))
    assert {r.doc_id: tuple(r)[1:] for r in B.bpe_digests(docs, RANKS, PATTERN).collect()} == want
    back = B.decode_documents(B.encode_documents(docs, RANKS, PATTERN, "doc_id", "text"), RANKS, PATTERN).collect()
    assert all(bytes(r.decoded) == r.row.text.encode() and len(r.ids) == want[r.row.doc_id][0] for r in back)


def test_edges(edge_docs, no_docs):
    counts, bpe = T.token_counts(edge_docs, MODEL).collect(), B.bpe_digests(edge_docs, RANKS, PATTERN).collect()
    assert len(counts) == len(bpe) == edge_docs.count()
    assert [(r.n_bytes, r.n_tokens) for r in counts if r.doc_id in (1, 2)] == [(0, 0), (0, 0)]
    assert [r.n_tokens for r in bpe if r.doc_id in (1, 2)] == [0, 0]
    assert any(r.doc_id is None for r in counts) and [r.over_limit for r in counts if r.doc_id == 7] == [True]
    assert T.token_counts(no_docs, MODEL).count() == B.bpe_digests(no_docs, RANKS, PATTERN).count() == 0


def test_words_are_encoded_once_whatever_stands_beside_them(monkeypatch):
    """No piece holds a letter beside these marks, so 40 words with 7 endings, in 2 places, are 80 parts and the marks."""
    seen, counts, rnd = [], T.Counts(MODEL, {}), random.Random(2)
    monkeypatch.setattr(counts, "encode", lambda keys, **more: seen.extend(keys) or PIECES.encode(keys, **more))
    words = ["".join(rnd.choices("abcdefgh", k=9)) for _ in range(40)]
    text = "".join(before + w + end for w in words for before in (" ", "\n") for end in ("", ".", ",", "!", "***", ").", "?&&"))
    assert counts.of(pa.array([text])).tolist() == [len(PIECES.encode(text))]
    assert len(seen) == len(set(seen)) < 250  # 560 pre-tokens


def test_models_that_change_characters_are_refused(tmp_path):
    """Between letter and accent no piece would tell that they are composed."""
    for rule in ("identity", "nmt_nfkc"):
        options = {"vocab_size": 280, "model_type": "bpe", "byte_fallback": True, "remove_extra_whitespaces": False, "minloglevel": 2}
        sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(["the cat sat on a mat"] * 9), model_prefix=f"{tmp_path}/{rule}", normalization_rule_name=rule, **options)
    sp, apart = T.processor(f"{tmp_path}/identity.model")
    assert sp.encode("the mat") and apart[256 * ord("x") + ord("y")] and not apart[256 * ord("a") + ord("t")]
    with pytest.raises(ValueError, match="cannot be counted"):
        T.processor(f"{tmp_path}/nmt_nfkc.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, *"tehxqzw.,*é\u0301ñß-", "▁▁", "th", "\u200b", "ＡＢ"]), max_size=40).map("".join))
def test_parts_add_up(text):
    """Against the library, and the parts of any text are that text."""
    pieces, piece = T.parts(pa.array([text, text] if text else []), T.processor(MODEL)[1])
    assert "".join(pieces.to_pylist()) == 2 * text and "".join(p for p, k in zip(pieces.to_pylist(), piece, strict=True) if k) == text
    assert COUNTS.of(pa.array(["x" + text, text])).tolist() == [len(PIECES.encode("x" + text)), len(PIECES.encode(text))]
