import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scanlake.llm import language_model as M
from scanlake.llm import recurrent, words
from scanlake.llm.common import written


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens}


def plain_scores(rows, model, wanted):
    """Scores of whole documents one token at a time, with words, classes and shares worked out from plain counts."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    own = sorted((w for w, c in counts.items() if c > 1 and len(w) <= 64), key=lambda w: (-counts[w], w))[: M.WORDS]
    slot = lambda w: int(M.SLOTS[w[-1] + 256 * (w[-2] if len(w) > 1 else 0)])
    tail = [[c for w, c in counts.items() if w not in set(own) and slot(w) == k] for k in range(M.TAIL)]
    mass = [sum(c - M.DISCOUNT for c in cs) for cs in tail]
    sizes = [counts[w] for w in own] + [sum(c for c in cs if c > 1) for cs in tail] + [sum(c for cs in tail for c in cs if c == 1)]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    number = {k: i for i, k in enumerate(order)}
    edges = recurrent.class_edges(np.array(sizes, dtype=float)[order])
    softmax = lambda a: a - math.log(np.exp(a).sum())
    out = {}
    for i, words in tokens:
        if i not in wanted:
            continue
        h, x, total = np.zeros(recurrent.HIDDEN), len(sizes), 0.0
        for w in words:
            z, n = model["embed"][x] @ model["input"] + model["bias"] + h @ model["state"]
            soft = lambda v: v / (1 + abs(v))
            gate, n = 0.5 + 0.5 * soft(z), soft(n)
            h = n + gate * (h - n)
            if w in own:
                x = number[own.index(w)]
            elif counts[w]:
                x = number[len(own) + slot(w)]
                total += math.log((counts[w] - M.DISCOUNT) / mass[slot(w)])
            else:
                x = number[len(sizes) - 1]
            c = int(np.searchsorted(edges, x, side="right")) - 1
            part = slice(edges[c], edges[c + 1])
            total += softmax(h @ model["to_class"] + model["class_bias"])[c] + softmax(model["to_word"][part] @ h + model["word_bias"][part])[x - edges[c]]
        out[i] = total / math.log(10)
    return out


def test_base_and_model_scores(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "TOKENS", 5000)
    monkeypatch.setattr(M, "PAIRS", 4000)
    monkeypatch.setattr(M, "WORDS", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    fitted = M.fitted
    monkeypatch.setattr(M, "fitted", lambda blocks, sizes, unseen: kept.setdefault("model", fitted(blocks, sizes, unseen)))
    got = M.language_model_scores(docs.repartition(3)).collect()
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == brute(rows)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    # the operator's scores are those of its model, word by word over whole documents
    model = {k: v.astype(float) for k, v in kept["model"].items()}
    have = {r.doc_id: r.score for r in got}
    assert all(abs(have[i] - s) < 1e-3 * max(1, abs(s)) for i, s in plain_scores(rows, model, {r[0] for r in rows[::5]}).items())


def test_edges(spark, edge_docs, no_docs):
    got = M.language_model_scores(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    n = next(iter(brute(rows).values()))[3]
    assert by[7].n_tokens == 60_001 and by[7].train_tokens == n  # a repeated row counts again
    assert M.language_model_scores(no_docs).count() == 0


def test_every_training_document_is_learnt_from(spark, sf_dir, monkeypatch):
    """Over the rounds the copies see all training tokens, each once."""
    monkeypatch.setattr(M, "TOKENS", 20_000)
    monkeypatch.setattr(M, "SHARD_TOKENS", 8000)
    seen, copies = [], M.trained_copies

    def watched(*given):
        out = copies(*given)
        seen.append([r.seen for r in out.select("seen").collect()])
        return out

    monkeypatch.setattr(M, "trained_copies", watched)
    n = M.language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)).first().train_tokens
    assert len(seen) > 2 and max(map(len, seen)) > 1 and sum(map(sum, seen)) == n


def test_models_are_averaged_in_a_tree(spark):
    rows = [(i + 1, (np.full(7, float(i)) * (i + 1)).tobytes()) for i in range(100)]
    got = M.averaged(written(spark.createDataFrame(rows, "seen long, sums binary").repartition(5), "models"), 100)
    assert np.allclose(got, sum(i * (i + 1) for i in range(100)) / sum(i + 1 for i in range(100)))


def test_words_are_those_of_the_contract():
    texts = [None, "", " \t\n ", "One two", " a\x0bB\x0cc\r\n", "x\x1cy\u00a0z \u00c4B"]
    found, lengths = words.words_of(pa.array(texts, pa.string()))
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and found.cast(pa.binary()).to_pylist() == sum(want, [])


def test_buckets_keep_equal_words_together():
    every = pa.array(["", "a", "b", "ab", "ba", "a", "", "\u00e4" * 70, "ab"])
    for part in (every, every[3:]):
        order, ends = M.in_buckets(part, 4)
        of = {i: k for k in range(4) for i in order[ends[k] : ends[k + 1]]}
        assert sorted(of) == list(range(len(part)))
        assert len({(w, of[i]) for i, w in enumerate(part.to_pylist())}) == len(set(part.to_pylist()))


def test_word_lists_travel_as_two_values(spark, edge_docs):
    for found in (["", "a", "été", "x" * 300], []):
        assert words.unpacked_words(*words.packed_words(pa.array(found, pa.string()))).to_pylist() == found
    cut = pa.array(["a", "", "bc", "d"], pa.string())[1:3]
    assert words.unpacked_words(*words.packed_words(cut)).to_pylist() == ["", "bc"]
    blocks = M.packed(edge_docs.selectExpr("doc_id", "false as held", "text"))
    assert all(t != "array<string>" for _, t in blocks.dtypes)
    row = blocks.first()
    assert len(row.sizes) == 4 * row.n_words
