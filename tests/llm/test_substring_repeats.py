import hashlib
import random

from scanlake.llm import substring_repeats as S


def brute(rows, span=20):
    out, first = {}, {}
    words = {i: [] if t is None else t.encode().split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), (i, k))
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < (i, k):
                gone |= set(range(k, k + span))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)] + ["a", "b"]
    passages = [rnd.choices(vocab, k=k) for k in (19, 20, 21, 35, 60, 200)] + [["same"] * 50, ["x", "y"] * 30]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p) // 2)
                words += p[a : a + rnd.randint(10, len(p))]
            else:
                words += rnd.choices(vocab, k=rnd.randint(1, 40))
        if out and rnd.random() < 0.15:
            words = list((out[rnd.randrange(len(out))][1] or "").split())
        out.append((rnd.randrange(10**6) * n + i, rnd.choice([" ", "\n", "  "]).join(words)))
    return out


def collected(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark, monkeypatch):
    for seed, together in ((1, 4096), (2, 7)):
        monkeypatch.setattr(S, "TOGETHER", together)
        rows = texts(seed, 250)
        got = collected(S.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
        want = brute(rows)
        assert got == want
        assert sum(x[1] for x in want.values()) > 1000


def test_spans_are_maximal(spark):
    words = [f"p{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(["q", *words[5:35], "r"]))]
    got = {r.row.doc_id: r for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 31)] and got[2].kept == "q r" and got[1].spans == []


def test_edges(spark, edge_docs, no_docs):
    long = " ".join(f"z{i}" for i in range(30))
    more = spark.createDataFrame([(None, long), (None, long), (8, long), (9, long), (9, long)], "doc_id long, text string")
    got = S.without_repeats(edge_docs.select("doc_id", "text").union(more), "doc_id").collect()
    assert len(got) == edge_docs.count() + 5
    empty = [r for r in got if r.row.doc_id in (1, 2, 3)]
    assert all((r.n_words, r.n_removed, r.kept) == (0, 0, "") for r in empty)
    assert [r.n_removed for r in got if r.row.doc_id == 8] == [0]
    assert [r.n_removed for r in got if r.row.doc_id == 9] == [30, 30]
    assert sorted(r.n_removed for r in got if r.row.doc_id is None) == [0, 30, 30]
    assert S.repeat_digests(edge_docs).count() == edge_docs.count()
    assert S.repeat_digests(no_docs).count() == 0


def test_repeated_rows_that_hold_their_text_first_keep_it(spark, monkeypatch):
    """Two equal rows are the earliest holders of a text that repeats a passage of its own; a later row has part of it, and an end of its own."""
    passage = [f"z{i}" for i in range(30)]
    text = " ".join([*passage, "and", *passage])
    other = " ".join([*passage[:25], *(f"y{i}" for i in range(10))])
    rows = [(None, text), (None, text), (3, " ".join(f"u{i}" for i in range(25)))] + [(3, " ".join(f"u{i}" for i in range(25)))]
    twice = [(5, " ".join(f"t{i}" for i in range(40))), (5, " ".join(f"t{i}" for i in range(40))), (6, " ".join(f"t{i}" for i in range(10, 40)))]
    half = [(7, " ".join([*(f"s{i}" for i in range(24)), "x", *(f"s{i}" for i in range(24))])), (7, " ".join(f"s{i}" for i in range(24)))]
    docs = spark.createDataFrame([*rows, *twice, *half, (None, other)], "doc_id long, text string")
    for together, parts in ((4096, 1), (1, 1), (4096, 5)):
        monkeypatch.setattr(S, "TOGETHER", together)
        got = [(r.row.doc_id, r.n_words, r.n_removed) for r in S.without_repeats(docs.repartition(parts), "doc_id").collect()]
        assert sorted(x for x in got if x[0]) == [(3, 25, 0), (3, 25, 0), (5, 40, 0), (5, 40, 0), (6, 30, 30), (7, 24, 0), (7, 49, 24)]
        assert sorted(x[1:] for x in got if x[0] is None) == [(35, 0), (61, 30), (61, 30)]


def test_one_phrase_in_all_documents_is_no_hot_anchor(spark, monkeypatch):
    """A phrase with other words around it in each document, and a passage around it in some: whole results, few rows under one key."""
    rnd = random.Random(9)
    phrase = [f"ph{i}" for i in range(8)]
    passage = [*(f"l{i}" for i in range(15)), *phrase, *(f"r{i}" for i in range(15))]
    rows = []
    for i in range(400):
        around = lambda k, i=i: [f"w{i}_{j}" for j in range(k)]
        middle = passage[rnd.randrange(10) : len(passage) - rnd.randrange(10)] if i % 7 == 0 else phrase
        rows.append((i, " ".join([*around(rnd.randrange(25)), *middle, *around(25)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (64, 4096):
        monkeypatch.setattr(S, "TOGETHER", together)
        assert collected(S.repeat_digests(docs.repartition(3))) == brute(rows)
        keyed = S._anchors_of(S._rows(docs.coalesce(1))).filter(f"kind = {S.OPEN}").groupBy("k1").count()
        assert keyed.agg({"count": "max"}).first()[0] <= S.MEET * -(-400 // together)
    assert sum(x[1] for x in brute(rows).values()) > 500
