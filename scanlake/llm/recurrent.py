"""A gated recurrent unit (an update gate, and a proposal for the state) with a class-factored softmax, in numpy: training by truncated backpropagation, and scoring.

Symbols are numbers in descending order of their counts; one more input symbol starts a document. Neighbours in that order make a class,
and P(symbol | state) = P(its class | state) * P(symbol | class, state). Classes share the square roots of the counts evenly: common
symbols are in small classes and rare ones in large, which takes the fewest outputs a token. Gates are algebraic, x / (1 + |x|) in
place of exponentials.
"""

from __future__ import annotations

import numpy as np

CLASSES, HIDDEN = 40, 24
#: Steps of a truncated window, the most lanes of documents side by side in training, and the updates that short inputs get at least.
WINDOW, LANES, UPDATES = 24, 320, 400
#: Lanes in scoring, and states whose outputs are computed at once.
WIDE, CHUNK = 512, 4096
#: Scores nearer to 0 than this need no shift before exponentials.
SMALL = 60


def class_edges(counts: np.ndarray) -> np.ndarray:
    """Where classes begin among symbols whose counts descend, and the end."""
    share = np.cumsum(np.sqrt(counts + 0.5))
    of = np.minimum((share / share[-1] * CLASSES - 1e-9).astype(int), CLASSES - 1)
    return np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(counts)]


def shapes(edges: np.ndarray) -> dict[str, tuple[int, ...]]:
    symbols, classes = int(edges[-1]), len(edges) - 1
    return {
        "embed": (symbols + 1, HIDDEN), "input": (2, HIDDEN, HIDDEN), "bias": (2, HIDDEN), "state": (2, HIDDEN, HIDDEN),
        "to_class": (HIDDEN, classes), "class_bias": (classes,), "to_word": (symbols, HIDDEN), "word_bias": (symbols,),
    }


def initial(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """A model that knows the symbols' counts, which descend, and nothing of their order."""
    edges = class_edges(counts)
    rnd = np.random.default_rng(seed)
    model = {k: (rnd.standard_normal(s) / np.sqrt(HIDDEN)).astype(np.float32) for k, s in shapes(edges).items()}
    for k in ("to_class", "to_word"):
        model[k] *= 0.1
    seen = counts + 0.5
    model["bias"][:] = 0
    model["class_bias"] = np.log(np.add.reduceat(seen, edges[:-1]) / seen.sum()).astype(np.float32)
    model["word_bias"] = np.log(seen / np.repeat(np.maximum.reduceat(seen, edges[:-1]), np.diff(edges))).astype(np.float32)
    return model


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()])


def shaped(values: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(edges).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def small_scores(model: dict) -> bool:
    """Whether no state, whose components lie between -1 and 1, gives a score so far from 0 that exponentials overflow or their sums vanish."""
    most = lambda weights, bias, axis: float((np.abs(weights).sum(axis=axis) + np.abs(bias)).max())
    return max(most(model["to_class"], model["class_bias"], 0), most(model["to_word"], model["word_bias"], 1)) < SMALL


def _softmax(scores: np.ndarray, chosen: np.ndarray, backward: bool, small: bool = False) -> np.ndarray:
    """Log-probabilities of the chosen columns; with backward, scores become the gradients of their negative sum. small: see small_scores."""
    if not small and max(scores.max(), -scores.min()) > SMALL:
        scores -= scores.max(axis=1, keepdims=True)
    at = np.arange(len(chosen)) * scores.shape[1] + chosen
    out = scores.ravel()[at]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    out -= np.log(total)
    if backward:
        scores *= (1 / total)[:, None]
        scores.ravel()[at] -= 1
    return out


def _outputs(model: dict, edges: np.ndarray, h: np.ndarray, y: np.ndarray, gradients: dict | None = None, small: bool = False) -> np.ndarray:
    """Natural log-probabilities of symbols y after states h (n, HIDDEN); with gradients, of their negative sum, returns those of h too."""
    backward = gradients is not None
    order = np.argsort(y, kind="stable")
    h, y = np.take(h, order, axis=0), y[order]
    own = np.searchsorted(edges, y, side="right") - 1
    scores = h @ model["to_class"]
    scores += model["class_bias"]
    out = _softmax(scores, own, backward, small)
    if backward:
        gradients["to_class"] += h.T @ scores
        gradients["class_bias"] += np.ones(len(y), h.dtype) @ scores
        dh = scores @ model["to_class"].T
    ends = np.searchsorted(y, edges)
    for c in np.flatnonzero((ends[1:] > ends[:-1]) & (np.diff(edges) > 1)):
        rows, part = slice(ends[c], ends[c + 1]), slice(edges[c], edges[c + 1])
        scores = h[rows] @ model["to_word"][part].T
        scores += model["word_bias"][part]
        out[rows] += _softmax(scores, y[rows] - edges[c], backward, small)
        if backward:
            gradients["to_word"][part] += scores.T @ h[rows]
            gradients["word_bias"][part] += np.ones(len(scores), h.dtype) @ scores
            dh[rows] += scores @ model["to_word"][part]
    result = np.empty(len(y))
    result[order] = out
    if not backward:
        return result
    back = np.empty_like(dh)
    back[order] = dh
    return result, back


def _soft(x: np.ndarray, slope: bool) -> np.ndarray | None:
    """x becomes x / (1 + |x|); returns the slope there, if asked for."""
    share = np.abs(x)
    share += 1
    np.reciprocal(share, out=share)
    x *= share
    return np.multiply(share, share, out=share) if slope else None


def _step(state: np.ndarray, given: np.ndarray, h: np.ndarray, backward: bool = False) -> tuple[np.ndarray, ...]:
    """The next state (lanes, HIDDEN), of `given` (2, lanes, HIDDEN), which changes; then what the way back needs."""
    given += np.matmul(h, state)
    slope = _soft(given, backward)
    gate, n = given
    gate *= 0.5
    gate += 0.5
    after = h - n
    after *= gate
    after += n
    return after, gate, n, slope


def _sums(rows: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their number x."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[x[first]] = np.add.reduceat(np.take(np.ascontiguousarray(rows.T), order, axis=1), first, axis=1).T
    return out


def _table(model: dict) -> np.ndarray:
    """What each input symbol gives to the gate and the proposal: (2, symbols, HIDDEN)."""
    return np.matmul(model["embed"], model["input"]) + model["bias"][:, None, :]


def window_gradients(model: dict, edges: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[dict, float, np.ndarray]:
    """Gradients of the mean negative log-probability of a window (steps, lanes), its value, and the state to carry on.

    real: where there are symbols; the rest fills lanes up.
    """
    steps, lanes = x.shape
    gradients = {k: np.zeros_like(v) for k, v in model.items()}
    table, small = _table(model), small_scores(model)
    kept, states, before = [], np.empty((steps, lanes, HIDDEN), h.dtype), np.empty((steps, lanes, HIDDEN), h.dtype)
    for t in range(steps):
        before[t] = h
        if starts[t].any():
            before[t, starts[t]] = 0
        h, *rest = _step(model["state"], np.take(table, x[t], axis=1), before[t], True)
        kept.append(rest)
        states[t] = h
    flat_states, flat_x, y = states.reshape(-1, HIDDEN), x.ravel(), y.ravel()
    if real is None or real.all():
        count = len(y)
        out, dstates = _outputs(model, edges, flat_states, y, gradients, small)
    else:
        at = np.flatnonzero(real.ravel())
        count = len(at)
        dstates = np.zeros_like(flat_states)
        out, dstates[at] = _outputs(model, edges, flat_states[at], y[at], gradients, small)
    dstates = dstates.reshape(steps, lanes, HIDDEN)
    given = np.empty((2, steps, lanes, HIDDEN), h.dtype)
    carry = np.zeros_like(h)
    back = np.ascontiguousarray(model["state"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        gate, n, slope = kept[t]
        dh = dstates[t]
        dh += carry
        np.multiply(dh, gate, out=carry)
        np.subtract(before[t], n, out=n)
        n *= dh
        n *= 0.5
        np.multiply(n, slope[0], out=given[0, t])
        dh -= carry
        np.multiply(dh, slope[1], out=given[1, t])
        for part in np.matmul(given[:, t], back):
            carry += part
        if starts[t].any():
            carry[starts[t]] = 0
    given, before = given.reshape(2, -1, HIDDEN), before.reshape(-1, HIDDEN)
    gradients["state"] += np.matmul(before.T, given)
    gradients["input"] += np.matmul(np.take(model["embed"], flat_x, axis=0).T, given)
    gradients["bias"] += np.matmul(np.ones(len(y), h.dtype), given)
    gradients["embed"] += _sums(np.matmul(given, model["input"].transpose(0, 2, 1)).sum(axis=0), flat_x, len(model["embed"]))
    for g in gradients.values():
        g /= count
    return gradients, -float(out.sum()) / count, h


def train(model: dict, edges: np.ndarray, documents: list[np.ndarray], rate: float = 0.01, seed: int = 0) -> tuple[dict, int]:
    """The model after one pass over documents (symbol arrays), and how many tokens it has seen: all."""
    if not documents:
        return model, 0
    rnd = np.random.default_rng(seed)
    documents = [documents[i] for i in rnd.permutation(len(documents))]
    tokens = np.concatenate(documents).astype(np.uint16)
    lanes = min(LANES, max(1, len(tokens) // (WINDOW * UPDATES)))
    steps = -(-len(tokens) // lanes)
    spare = steps * lanes - len(tokens)
    lane = lambda v: np.r_[v, np.zeros(spare, v.dtype)].reshape(lanes, steps).T
    first = np.zeros(len(tokens), dtype=bool)
    first[np.cumsum([0, *map(len, documents[:-1])])] = True
    before = np.r_[np.uint16(0), tokens[:-1]]
    before[first] = len(model["embed"]) - 1
    x, y, first, real = lane(before), lane(tokens), lane(first), lane(np.ones(len(tokens), dtype=bool))
    m, v = ({k: np.zeros_like(p) for k, p in model.items()} for _ in range(2))
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    updates = range(0, steps, WINDOW)
    for i, t in enumerate(updates, 1):
        part = slice(t, min(t + WINDOW, steps))
        gradients, _, h = window_gradients(model, edges, x[part], y[part], first[part], h, real[part])
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in gradients.values()))
        now = rate * (1 - 0.9 * i / len(updates)) * np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        for k, g in gradients.items():
            g *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] += np.float32(0.1) * (g - m[k])
            g *= g
            g -= v[k]
            g *= np.float32(0.01)
            v[k] += g
            np.sqrt(v[k], out=g)
            g += np.float32(1e-7)
            np.divide(m[k], g, out=g)
            g *= np.float32(now)
            model[k] -= g
    return model, len(tokens)


def log_probabilities(model: dict, edges: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """The natural log-probability of each whole document; the state is carried from its first symbol to its last."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    result = np.zeros(len(documents))
    if not lengths.sum():
        return result
    lanes = min(WIDE, len(documents))
    # Longest first, each to the lane with least work, so that lanes end at about the same step.
    load, queues = np.zeros(lanes, dtype=np.int64), [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable"):
        if lengths[d]:
            lane = int(load.argmin())
            queues[lane].append(d)
            load[lane] += lengths[d]
    by_load = np.argsort(-load, kind="stable")
    queues, load = [queues[i] for i in by_load], load[by_load]
    steps, start = int(load[0]), len(model["embed"]) - 1
    y, x, of = (np.zeros((steps, lanes), dtype=d) for d in (np.uint16, np.uint16, np.int32))
    for i, queue in enumerate(queues):
        tokens = np.concatenate([documents[d] for d in queue]) if queue else np.zeros(0, np.uint16)
        y[: len(tokens), i], x[1 : len(tokens), i] = tokens, tokens[:-1]
        of[: len(tokens), i] = np.repeat(queue, lengths[queue]) if queue else 0
        x[np.cumsum(np.r_[0, lengths[queue][:-1]]) if queue else [], i] = start
    active = np.searchsorted(-load, -np.arange(steps), side="left")
    fresh = (x == start).any(axis=1)
    table, small = _table(model), small_scores(model)
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    states, targets, owners, held = [], [], [], 0
    for t in range(steps):
        n = int(active[t])
        h, now = h[:n], x[t, :n]
        if fresh[t]:
            h = np.where((now == start)[:, None], np.float32(0), h)
        h = _step(model["state"], np.take(table, now, axis=1), h)[0]
        states.append(h)
        targets.append(y[t, :n])
        owners.append(of[t, :n])
        held += n
        if held >= CHUNK or t + 1 == steps:
            found = _outputs(model, edges, np.concatenate(states), np.concatenate(targets), small=small)
            result += np.bincount(np.concatenate(owners), weights=found, minlength=len(documents))
            states, targets, owners, held = [], [], [], 0
    return result
