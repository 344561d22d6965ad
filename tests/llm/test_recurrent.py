import numpy as np

from scanlake.llm import recurrent as R


def model(symbols=156, seed=1):
    rnd = np.random.default_rng(seed)
    counts = np.sort(rnd.integers(1, 5000, symbols) ** 2)[::-1].astype(float)
    return {k: (v + 0.3 * rnd.standard_normal(v.shape)).astype(np.float32) for k, v in R.initial(counts).items()}, R.class_edges(counts)


def test_classes_cover_symbols_once():
    for counts in (np.ones(1), np.array([9.0, 1, 0]), np.arange(5000, 0, -1.0) ** 2, np.zeros(4161)):
        edges = R.class_edges(counts)
        assert edges[0] == 0 and edges[-1] == len(counts) and (np.diff(edges) > 0).all() and len(edges) <= R.CLASSES + 1


def test_probabilities_sum_to_one():
    m, edges = model()
    h = np.random.default_rng(2).standard_normal((1, R.HIDDEN)).astype(np.float32)
    for scale in (1, 200):  # the second takes the guarded way
        assert abs(np.exp(R._outputs(m, edges, np.repeat(scale * h, 156, axis=0), np.arange(156))).sum() - 1) < 1e-4


def test_gradients_match_differences():
    m, edges = model(75)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(0, 76, (5, 4)), rnd.integers(0, 75, (5, 4))
    starts, real = rnd.random((5, 4)) < 0.3, rnd.random((5, 4)) < 0.8
    h = rnd.standard_normal((4, R.HIDDEN))
    for mask in (None, real):
        g, _, _ = R.window_gradients(m, edges, x, y, starts, h, mask)
        for k, v in m.items():
            at = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
            old, loss = v[at], []
            for e in (1e-5, -1e-5):
                v[at] = old + e
                loss.append(R.window_gradients(m, edges, x, y, starts, h, mask)[1])
            v[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k


def test_lanes_do_not_change_scores(monkeypatch):
    m, edges = model()
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, 156, n).astype(np.uint16) for n in (1, 3, 700, 40, 0, 5, 5, 90)]
    want = []
    for d in docs:
        h, total = np.zeros((1, R.HIDDEN), dtype=np.float32), 0.0
        for a, b in zip([len(m["embed"]) - 1, *d[:-1]][: len(d)], d, strict=True):
            h = R._step(m["state"], R._table(m)[:, [a]], h)[0]
            total += R._outputs(m, edges, h, np.array([b]))[0]
        want.append(total)
    for lanes, chunk in ((256, 128), (2, 16)):
        monkeypatch.setattr(R, "WIDE", lanes)
        monkeypatch.setattr(R, "CHUNK", chunk)
        assert np.allclose(R.log_probabilities(m, edges, docs), want, rtol=1e-4)


def test_training_learns_order():
    rnd = np.random.default_rng(5)
    docs = [np.arange(rnd.integers(0, 20), 60) % 20 for _ in range(3000)]
    counts = np.bincount(np.concatenate(docs), minlength=26).astype(float)
    order = np.argsort(-counts, kind="stable")
    docs, counts = [np.argsort(order)[d] for d in docs], counts[order]
    before, edges = R.initial(counts), R.class_edges(counts)
    start = R.log_probabilities(before, edges, docs).sum()
    after, seen = R.train({k: v.copy() for k, v in before.items()}, edges, docs)
    assert seen == sum(map(len, docs)) and R.log_probabilities(after, edges, docs).sum() > 0.5 * start


def test_scores_need_no_shift_where_weights_are_small():
    """The bound on scores decides for all states at once, and does not change a result; large weights fail it and are shifted as before."""
    sizes = np.sort(np.random.default_rng(5).integers(1, 1000, 60))[::-1].astype(float)
    model, edges = R.initial(sizes), R.class_edges(sizes)
    rnd = np.random.default_rng(6)
    h, y = rnd.uniform(-1, 1, (50, R.HIDDEN)).astype(np.float32), rnd.integers(0, len(sizes), 50).astype(np.uint16)
    assert R.small_scores(model) and (R._outputs(model, edges, h, y, small=True) == R._outputs(model, edges, h, y)).all()
    model["to_word"][:] = 100
    model["to_class"][:] *= 1e4
    assert not R.small_scores(model)
    assert np.isfinite(R.log_probabilities(model, edges, [y, y[:3]])).all()
