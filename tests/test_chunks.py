"""Chunks of a hot key's rows, and hash trees."""

import hashlib
import random

from pyspark.sql import functions as F

from scanlake.operators import chunks as C


def test_places_of_a_hot_key(spark, monkeypatch):
    """A key that lies in several ranges, keys of one row, null keys, and equal rows."""
    monkeypatch.setattr(C, "RANGE", 40)
    rnd = random.Random(2)
    rows = [("hot", rnd.randrange(300)) for _ in range(700)] + [(f"k{i}", 1) for i in range(50)] + [(None, v) for v in range(60)]
    rnd.shuffle(rows)
    got = C.places(spark.createDataFrame(rows, "k string, t int").repartition(7), "k", "t").collect()
    for key in {k for k, _ in rows}:
        own = sorted((r.i, r.t) for r in got if r.k == key)
        assert [i for i, _ in own] == list(range(1, len(own) + 1)) and [t for _, t in own] == sorted(t for k, t in rows if k == key)
    found = C.chunked(spark.createDataFrame(rows, "k string, t int"), "k", ["t"], F.col("t"), 64).collect()
    assert max(r.n for r in found) == 64 and all(r.n == len(r.found) for r in found)
    for key in {k for k, _ in rows}:
        parts = sorted((r.chunk, r.found) for r in found if r.k == key)
        assert [c for c, _ in parts] == list(range(len(parts))) and sum((p for _, p in parts), []) == sorted(t for k, t in rows if k == key)
    assert C.chunked(spark.createDataFrame([], "k string, t int"), "k", ["t"], F.col("t"), 3).count() == 0


def test_hash_trees(spark, monkeypatch):
    files = {f"d/{i}.png": hashlib.md5(str(i).encode()).hexdigest() for i in range(200)}
    table = lambda d: spark.createDataFrame(list(d.items()), "path string, digest string").repartition(5)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    monkeypatch.setattr(C, "LEAF", 2)
    tree = {(r.level, r.node): (r.n, r.digest) for r in C.hash_tree(table(files)).collect()}
    assert max(level for level, _ in tree) == 2 and tree[0, ""][0] == 200
    leaves = {}
    for path in sorted(files):
        leaves.setdefault(md5(path)[:2], []).append(f"{path}:{files[path]}")
    assert {node: d for (level, node), (_, d) in tree.items() if level == 2} == {k: md5(",".join(v)) for k, v in leaves.items()}
    other = files | {"d/7.png": "changed", "d/new.png": "x"}
    del other["d/9.png"]
    touched = {md5(p)[:2] for p in ("d/7.png", "d/new.png", "d/9.png")}
    found = C.tree_differences(C.hash_tree(table(files), 2), C.hash_tree(table(other), 2)).collect()
    assert {r.node for r in found if r.level == 2} == touched and {r.node for r in found if r.level == 1} == {t[0] for t in touched} and len([r for r in found if r.level == 0]) == 1
    assert C.tree_differences(C.hash_tree(table(files), 2), C.hash_tree(table(dict(reversed(files.items()))), 2)).count() == 0
    assert C.hash_tree(table(files).limit(0)).filter("level > 0").count() == 0
