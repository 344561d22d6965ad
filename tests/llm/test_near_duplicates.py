import random

import numpy as np

from scanlake.llm import near_duplicates as N
from scanlake.llm.components import components


def brute(rows, percent=75):
    sets = {}
    for i, text in rows:
        w = [] if text is None else text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choices(vocab, k=30))
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            words = (rnd.choice(out)[1] or "x").split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 5, 8, 20, 60, 200])))
            if rnd.random() < 0.5:
                text = f"{shared} {text}"
        out.append((i, text if rnd.random() < 0.98 else None))
    return out


def collected(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = texts(3, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collected(N.near_duplicates(df)) == brute(rows)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 1)
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "STARS", 1)
    rows = texts(5, 150)
    assert collected(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def template_pages(seed, n):
    """Pages of one template, about 0.6 alike, so that nearly all share buckets and no star decides them; some have a near copy."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        own = [f"p{i}x{k}" for k in range(30)]
        out.append((2 * i, " ".join(template + own)))
        if i % 5 == 0:
            own[rnd.randrange(30)] = "changed"
            out.append((2 * i + 1, " ".join(template + own)))
    return out


def test_one_bucket_holds_nearly_all_pages_of_a_template(spark, monkeypatch):
    """What a template shares brings no pages together after the stars: only near copies meet by a rare shingle."""
    compared, similarities = [], N.similarities

    def watched(pairs, whole):
        compared.append(pairs.count())
        return similarities(pairs, whole)

    monkeypatch.setattr(N, "bands", lambda found: np.array([7], dtype=np.uint64))
    monkeypatch.setattr(N, "STARS", 2)
    monkeypatch.setattr(N, "LARGE", 20)
    monkeypatch.setattr(N, "similarities", watched)
    rows = template_pages(1, 60)
    assert collected(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    assert compared[:2] == [71, 70] and compared[2] <= 20, compared


def test_edges(spark, edge_docs, no_docs):
    got = N.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 8]
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[5].kept
    assert by_id[1].component_id == 1 and by_id[2].component_id == 2
    null = next(r for r in got if r.doc_id is None)
    assert null.component_id is None and null.kept
    assert N.near_duplicates(no_docs).count() == 0


def test_signature_fills_every_bin():
    for n in (1, 2, 5, 100, 5000):
        found = np.unique(N.mix(np.arange(n, dtype=np.uint64) + np.uint64(7)))
        assert set(N.signature(found).tolist()) <= set(found.tolist())


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(30)]
    star = [(1000, i) for i in range(100, 130)] + [(7000, 7000), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(path + star + path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 130), 1000]}
