import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import top_k as K
from scanlake.llm import vector_duplicates as V

BAD = [(900, None), (950, [None, 1.0]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (1100, [0.0] * 8), (1150, [])]
SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed, n, d=8, groups=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((groups, d))
    x = centres[rnd.integers(0, groups, n)] + 0.35 * rnd.standard_normal((n, d))
    x[: n // 10] = x[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, more=()):
    rows = [(i * 5, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *more], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "size", "vector", "label", "block")})


def brute_top(rows, k=5):
    ids = [i for i, _ in rows]
    q = [np.floor(256 * np.asarray(v, dtype=np.float64)).astype(np.int64) for _, v in rows]
    width = max(map(len, q))
    q = np.array([np.r_[v, np.zeros(width - len(v), dtype=np.int64)] for v in q])
    out = set()
    for a, i in enumerate(ids):
        if i % 50 == 0:
            s = q @ q[a]
            best = sorted((-int(s[b]), j) for b, j in enumerate(ids) if j != i)[:k]
            out |= {(i, r + 1, j, -t) for r, (t, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("rows, queries", [(10_000, 10_000), (64, 7)])
def test_top_k_equals_brute_force(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(K, "ROWS", rows)
    monkeypatch.setattr(K, "QUERIES", queries)
    x = vectors(1, 400)
    df = frame(spark, x, BAD)
    fine = [(i * 5, row) for i, row in enumerate(x)] + [(1150, []), (1100, [0.0] * 8)]
    fine = [(i, v) for i, v in fine if i not in (1100, 1150)] + [(1100, min(x[220].tolist(), [0.0] * 8)), (1150, [])]
    got = {tuple(r) for r in K.top_k(df, F.pmod("vec_id", F.lit(50)) == 0).collect()}
    assert got == brute_top(fine)


def test_a_block_spans_arrow_batches(spark, monkeypatch):
    """Rows of a block and its queries arrive in many Arrow batches, and a task has more than one block."""
    monkeypatch.setattr(K, "ROWS", 90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        x = vectors(5, 300)
        got = {tuple(r) for r in K.top_k(frame(spark, x).coalesce(2), F.pmod("vec_id", F.lit(50)) == 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_top([(i * 5, row) for i, row in enumerate(x)])


def test_top_k_small_tables(spark):
    is_query = F.pmod("vec_id", F.lit(50)) == 0
    assert K.top_k(spark.createDataFrame([], SCHEMA), is_query).count() == 0
    assert K.top_k(spark.createDataFrame([(0, [0.5])], SCHEMA), is_query).count() == 0
    two = spark.createDataFrame([(0, [0.5]), (1, [-0.1]), (1, [-0.1])], SCHEMA)
    assert [tuple(r) for r in K.top_k(two, is_query).collect()] == [(0, 1, 1, 128 * -26)]


def brute_links(x):
    c = x.astype(np.float64)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    linked = c @ c.T >= 0.9
    np.fill_diagonal(linked, False)
    return linked


def test_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 64)
    monkeypatch.setattr(V, "BLOCK", 50)
    x = vectors(2, 600, d=32)
    got = {r.vec_id: r for r in V.vector_duplicates(frame(spark, x, [b for b in BAD if b[0] is None or b[0] < 1100])).collect() if r.vec_id is not None}
    linked = brute_links(x)
    want = linked.sum(axis=1)
    found = np.array([got[i * 5].n_links if i * 5 not in (900, 950, 1000, 1050) else want[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()


@pytest.mark.parametrize("times", [1, 3])
def test_large_leaves_are_split_again(spark, monkeypatch, times):
    """First cuts that are far too few for the table: leaves are split by trees of their own, links are counted once, and few are lost."""
    for name, value in {"SAMPLE": 100, "LARGE": 40, "MEMBERS": 30, "PLACED": 16, "LEAF": 20, "TIMES": times}.items():
        monkeypatch.setattr(V, name, value)
    x = vectors(2, 600, d=32)
    sizes = []
    compare = V.split_again
    monkeypatch.setattr(V, "split_again", lambda rows: sizes.append((rows, compare(rows))) or sizes[-1][1])
    got = {r.vec_id: r for r in V.vector_duplicates(frame(spark, x)).collect()}
    want = brute_links(x).sum(axis=1)
    found = np.array([got[i * 5].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    before, after = ([r["count"] for r in rows.groupBy("leaf").count().collect()] for rows in sizes[0])
    assert len(after) > 2 * len(before) and max(after) < max(before)
    assert {r.id for r in sizes[0][0].select("id").distinct().collect()} == {r.id for r in sizes[0][1].select("id").distinct().collect()}


def test_vectors_that_no_cut_parts_lose_no_link(spark, monkeypatch):
    """A third of all vectors are within a cut's margin of each other: their leaf stays whole and is compared in blocks."""
    for name, value in {"SAMPLE": 100, "LARGE": 40, "MEMBERS": 30, "PLACED": 16, "LEAF": 20, "BLOCK": 25}.items():
        monkeypatch.setattr(V, name, value)
    x = np.random.default_rng(3).standard_normal((240, 16))
    x[::3] = x[0] + 1e-3 * np.random.default_rng(4).standard_normal((80, 16))
    got = {r.vec_id: r.n_links for r in V.vector_duplicates(frame(spark, x)).collect()}
    assert all(got[i * 5] == 79 for i in range(0, 240, 3))


def test_cosine_of_exactly_the_threshold(spark):
    """9 / (1 * 10) is 0.9 and links; one unit in the last place less does not, whatever the vectors' sizes."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0]), (2, [0.0, 9e-300, 0.0, 0.0]), (3, [0.0, 9.0, -3.0, 1.0]), (4, [0.0, 0.0, 0.0, -1.0])]
    rows.append((5, [0.0, 0.0, -9.0 * (1 - 2**-40), -3.0]))
    df = spark.createDataFrame([*rows, (6, [0.0, 0.0, 3.0, 1.0]), (7, [-9.0, 0.0, 3.0, 1.0 + 2**-40])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in V.vector_duplicates(df).collect()}

    def cosine(a, b):
        return sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) ** 0.5 * sum(q * q for q in b) ** 0.5)

    by_id = {r.vec_id: [v * (1e300 if r.vec_id == 2 else 1) for v in r.embedding] for r in df.collect()}
    assert cosine(by_id[0], by_id[1]) == 0.9
    assert got == {i: sum(cosine(u, v) >= 0.9 for j, v in by_id.items() if j != i) for i, u in by_id.items()}
    assert got[0] == 1


def test_duplicates_edges(spark):
    rows = [(3, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [2.0, 0.0]), (9, [0.9, 0.435]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (None, [1.0, 0.0]), (7, [float("nan"), 1.0]), (8, [])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.vector_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 9: (3, 1, False), **{i: (0, i, True) for i in (4, 5, 6, 7, 8)}, None: (0, None, True)}
    assert V.vector_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sizes_do_not_matter_to_cosine(spark):
    rows = [(i, [v * s for v in (1.0, 2.0, -0.5)]) for i, s in enumerate((1.0, 1e200, 1e-200, 5e-324 * 4, 1e307))] + [(9, [-1e200, 1.0, 0.0])]
    got = {r.vec_id: r.n_links for r in V.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 9: 0}


def test_short_vectors_are_whole():
    rnd = np.random.default_rng(1)
    for x in (rnd.standard_normal(7).astype(np.float32).astype(float), rnd.standard_normal(7), np.array([1e300, 1.0])):
        assert (V.long([V.short(x)])[0] == x).all()
    assert len(V.short(np.ones(8))) == 33 and len(V.short(np.full(8, 0.1))) == 65


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        K.top_k(df, F.pmod("vec_id", F.lit(50)) == 0).collect()


def test_proven_scores_pass_over_blocks():
    """A block whose bound is under a proven score is not searched; one whose bound meets it is, ties included."""
    x = np.array([[3, 1], [2, 2], [1, 3]])
    index, ids = K.Index(x), np.array([10, 11, 12])
    query = np.array([2, 1])
    assert len(index.search(query, 2, -1, ids, proven=10)[0]) == 0
    at, scores = index.search(query, 2, -1, ids, proven=7)
    assert scores.tolist() == [7, 6] or scores.tolist() == [7]


def test_planted_links_at_default_sizes(spark):
    """Several leaves of the default size: planted pairs of cosine 0.9 to 0.99 are found, and no link that brute force does not have."""
    rnd = np.random.default_rng(11)
    x = rnd.standard_normal((6_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rnd.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rnd.uniform(0.9, 0.99, (len(x), 1))
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other])
    got = {r.vec_id: r for r in V.vector_duplicates(frame(spark, x)).collect()}
    linked = brute_links(x)
    found = np.array([got[i * 5].n_links for i in range(len(x))])
    want = linked.sum(axis=1)
    assert len(x) > 2 * V.LEAF and (found <= want).all() and found.sum() >= 0.9 * want.sum() > 10_000
    pairs = [i for i in range(6_000) if got[(i + 6_000) * 5].component_id == i * 5]
    assert len(pairs) >= 0.9 * 6_000
