import re
from collections import Counter
from itertools import permutations

import numpy as np

from scanlake.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """Every order applied to every document, one filter after another."""
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, quality, bad in labels:
        good |= {doc_id} if quality == 1 and doc_id is not None else set()
        toxic |= {doc_id} if bad == 1 and doc_id is not None else set()
    parts = {}
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > first[t]), strict=True) if f}
        parts.setdefault(source or "", []).append((fails, doc_id in good, doc_id in toxic))
    rows, shapley = [], Counter()
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, c in enumerate(order, 1):
                gone, left = [m for m in left if c in m[0]], [m for m in left if c not in m[0]]
                failing = sum(c in m[0] for m in members)
                shapley[part, c] += len(gone)
                rows.append([part, order, step, len(left), len(gone), failing - len(gone), sum(m[0] == {c} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def audit(docs, labels):
    got = A.filter_audit(docs, labels)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def test_against_filters_applied_in_turn(spark):
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(["a", "Bc", "dé", "e$"] if i % 3 else [f"w{j}" for j in range(300)], 150 + 30 * (i % 5))) for i in range(40)]
    docs = [(i, texts[int(rnd.integers(40))], ["s", "t", None, ""][i % 4]) for i in range(300)]
    docs += [(i, t, "u") for i, t in enumerate([None, "", None, " ", "X", "ÄX"], 300)] + [(7, docs[7][1], "t"), (7, docs[7][1], "s"), (None, docs[9][1], "s"), (None, "alone", None), (None, None, "t")]
    labels = [(i, int(rnd.integers(2)), int(rnd.integers(2))) for i in range(0, 320, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (6, None, None)]
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == plain(docs, labels)


def test_over_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert audit(docs, labels) == plain([(r.doc_id, r.text, r.source) for r in docs.collect()], list(map(tuple, labels.select("doc_id", "quality", "toxic").collect())))


def test_removal_steps():
    orders, steps = A.removal_steps(3)
    assert len(orders) == 6 and steps.shape == (8, 6)
    for o, order in enumerate(orders.tolist()):
        for mask in range(8):
            assert steps[mask, o] == min((at for at, f in enumerate(order) if mask >> f & 1), default=3)


def test_any_number_of_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 2, 1), ("p", 3, 4, 0, 4), ("q", 2, 1, 0, 0)], "part string, failed int, n long, good long, toxic long")
    got = sorted(map(tuple, A.interactions(masks, "XY").collect()))
    assert got == [
        ("p", "XY", 1, 5, 7, 0, 3, 2, 5, 10), ("p", "XY", 2, 5, 0, 4, 0, 0, 0, 4), ("p", "YX", 1, 8, 4, 0, 0, 0, 4, 4), ("p", "YX", 2, 5, 3, 4, 3, 2, 1, 10),
        ("q", "XY", 1, 1, 0, 0, 0, 0, 0, 0), ("q", "XY", 2, 0, 1, 0, 1, 0, 0, 2), ("q", "YX", 1, 0, 1, 0, 1, 0, 0, 2), ("q", "YX", 2, 0, 0, 0, 0, 0, 0, 0),
    ]


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (7, 0, 1, "x")], "doc_id long, quality int, toxic int, n string")
    assert audit(edge_docs, labels) == plain([(r.doc_id, r.text, r.source) for r in edge_docs.collect()], [(5, 1, 0), (7, 0, 1)])
    assert audit(no_docs, labels) == [] and len(audit(edge_docs, labels.limit(0))) == 600 * 4
