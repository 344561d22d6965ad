import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scanlake.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """All scores by the formula, all documents sorted."""
    found = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    found = [(doc_id, c, sum(c.values())) for doc_id, c in found if c]
    N, L = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for item_id, text in items:
        if item_id is not None:
            asked.setdefault(item_id, set()).update(terms(text))
    rows = []
    for item_id, ts in asked.items():
        scores = []
        for doc_id, c, n in found:
            m = 100 - 50 + (50 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        rows += [(item_id, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def search(spark, docs, items, k):
    got = S.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_search(spark, monkeypatch, seed):
    """Shards of a few documents, first stretches of two postings, several blocks of queries, many ties."""
    for name, value in {"SHARD_DOCS": 48, "SHARD_POSTINGS": 200, "STRETCH": 2, "BLOCK": 40, "SHARE": 4}.items():
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "日本", "A1", "x"]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rnd.choice([1, 3, 20, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(120)] + [(None, docs[3][1]), (5, docs[5][1]), (2000, None), (2001, " \n--"), (2002, "")]
    rnd.shuffle(docs)
    items = [(i, text(rnd.choice([1, 4, 30]))) for i in range(30)] + [(7, "more terms w3"), (None, "w1 w2"), (90, None), (91, ""), (92, "nowhere to be found"), (93, "W1 w1 w1")]
    for k in (1, 5, 50, 2000):
        assert search(spark, docs, items, k) == plain(docs, items, k)


def test_a_shard_stops_early_and_stays_exact():
    """Lists are not read to their ends where that cannot change the result, and ties at the last place are all returned."""
    rnd = np.random.default_rng(3)
    docs, vocabulary = 5000, 12
    sizes = rnd.integers(1, vocabulary, docs)
    term_lists = [np.sort(rnd.choice(vocabulary, s, replace=False)) for s in sizes]
    times = rnd.integers(1, 4, sizes.sum())
    shard = S.Shard(np.full(docs, 10), sizes, np.concatenate(term_lists).astype(np.int32), times, docs, 10 * docs)
    weights = rnd.integers(1, 5000, vocabulary)
    scores = np.zeros(docs, dtype=np.int64)
    np.add.at(scores, np.repeat(np.arange(docs), sizes), weights[np.concatenate(term_lists)] * (10**9 * times // (1000 * times + 20 * 100)))
    for k in (1, 10, 50):
        for proven in (0, int(np.sort(scores)[-k]), int(scores.max()) + 1):
            at, got = shard.search(np.arange(vocabulary, dtype=np.int32), weights, k, proven)
            least = max(proven, int(np.sort(scores)[-k]))
            assert sorted(at.tolist()) == np.flatnonzero(scores >= least).tolist() and (scores[at] == got).all()


def test_terms():
    texts = pa.array(["", "Ab-cÉ_d", "  ", "日本　語 x\x7fy", "a" * 300_000 + "." + "B" * 5])
    words, row = S.words_and_rows(texts.slice(1))
    assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == [(0, "ab"), (0, "cÉ"), (0, "d"), (2, "日本　語"), (2, "x"), (2, "y"), (3, "a" * 300_000), (3, "bbbbb")]


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "quick w1x1 the words", "x"), (2, None, "x"), (3, "absent", "x")], "item_id long, text string, score string")
    got = S.lexical_search(edge_docs, items, 10).collect()
    want = plain([(r.doc_id, r.text) for r in edge_docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(map(tuple, got), key=str) == want and {r.item_id for r in got} == {1}
    assert S.lexical_search(no_docs, items).count() == 0
    assert S.lexical_search(edge_docs, items.filter("item_id > 5")).count() == 0
