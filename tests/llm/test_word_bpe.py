import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scanlake.llm import word_bpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, CODE = Tokenizer.from_file(PATH), W.encoder(PATH)
PARTS = [
    "a", "b", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "é", "é", "́", "'s", "'", "'S", "1", "23", "===", "日", "本", "ing", "The", "Σ", "ΑΣ",
    "İ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|endof", "</w>", "<", "|>", "🙂", "👩‍👩‍👧", "don't ", "'re", "'l", "l", "'LL", "''s", "!'s", "s's", "'v", "e", "'d", "m'", "<", "|", "~", "\x7f", "\x00", "ᄒ", "ᅡ", "ᆫ", "ǅ", "ẞ", "aaaa", "hahaha",
]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60).filter(lambda s: s.encode("utf-8", "ignore").decode() == s))
def test_encoder_equals_the_library(text):
    ids, n = CODE.encode(pa.array([None, text, "", text]))
    want = ids_of(text)
    assert n.tolist() == [0, len(want), 0, len(want)] and ids.tolist() == want * 2
    assert b"".join(CODE.contents.joined(ids[: n[1]])).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_words_and_hard_merges():
    rnd = random.Random(4)
    tokens = [t.removesuffix("</w>") for t, i in LIBRARY.get_vocab().items() if i < 49_000 and t.isascii() and t.isalpha()]
    texts = ["a" * 20_000, "ab" * 9_000, "thethethe" * 3_000, "=" * 10_000, "日本語" * 3_000, "haha" * 5_000]
    texts += ["".join(rnd.choices("aeinrstlo", k=3_000)) for _ in range(10)] + ["".join(rnd.choices(tokens, k=400)) for _ in range(20)]
    for text in texts:
        assert CODE.encode(pa.array([text]))[0].tolist() == ids_of(text)


def test_every_token_of_the_vocabulary():
    words = [t.removesuffix("</w>") for t in LIBRARY.get_vocab() if t.isascii() and t.strip("</w>").isalnum()]
    text = " ".join(words)
    assert CODE.encode(pa.array([text]))[0].tolist() == ids_of(text)


def test_full_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(W, "CACHE", 3)
    monkeypatch.setattr(W, "PAIRS", 2)
    monkeypatch.setattr(W, "AT_ONCE", 2)
    code = W.Encoder(PATH)
    for text in ("unbelievably long sentences without meaning", "meaning without sentences " * 5):
        ids, _ = code.encode(pa.array([text]))
        assert ids.tolist() == ids_of(text) and b"".join(code.numbers.joined(ids)).decode() == " ".join(map(str, ids_of(text)))
        assert len(code.pieces) <= 3 and len(code.compatible) <= 2


def test_other_tokenizers_are_refused(tmp_path):
    told = json.load(open(PATH, encoding="utf-8"))
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": {"type": "NFC"}}, {"model": told["model"] | {"dropout": 0.1}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(told | change), encoding="utf-8")
        with pytest.raises(ValueError):
            W.Encoder(str(path))


def digests(text):
    ids = ids_of(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: digests(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in W.word_bpe_digests(docs, PATH).collect()} == want
    back = W.decode_documents(W.encode_documents(docs, PATH, "doc_id"), PATH).collect()
    assert {r.row.doc_id: (len(r.ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in back} == {k: (v[0], v[2]) for k, v in want.items()}


def test_edges(edge_docs, no_docs):
    got = W.word_bpe_digests(edge_docs, PATH).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r.doc_id, *digests(r.text))) for r in edge_docs.collect())
    assert W.word_bpe_digests(no_docs, PATH).count() == W.encode_documents(no_docs, PATH, "doc_id").count() == 0
    assert [r.decoded for r in W.decode_documents(W.encode_documents(edge_docs, PATH, "doc_id", "word"), PATH).collect() if r.row.doc_id in (1, 2, 3)] == ["", "", ""]
