"""A gated recurrent language model in numpy: training by truncated backpropagation, and scoring.

Words are numbered by falling count and cut into classes of neighbours; the output is a softmax over
classes times one over the words of the class. Both start at the words' frequencies, so an
untrained model is the unigram model of its vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from chainspark.functions.blas import one_thread  # noqa: F401


@dataclass(frozen=True)
class Shape:
    """Sizes of a model: words, first word of each class (and the number of words), hidden and embedding units."""

    firsts: tuple[int, ...]
    hidden: int = 32
    embed: int = 24

    @property
    def words(self) -> int:
        return self.firsts[-1]

    @property
    def classes(self) -> int:
        return len(self.firsts) - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, e = self.hidden, self.embed
        return {"embed": (self.words, e), "input": (e, 3 * h), "input_bias": (3 * h,), "recur": (h, 3 * h),
                "recur_bias": (h,), "to_class": (h, self.classes), "class_bias": (self.classes,), "to_word": (self.words, h),
                "word_bias": (self.words,)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())


def classes_of(counts: np.ndarray) -> tuple[int, ...]:
    """Classes of neighbours with about equal shares of the square roots of the counts."""
    n = max(1, int(round(len(counts) ** 0.5)))
    mass = np.cumsum(np.sqrt(counts + 1.0))
    slot = np.minimum((mass - np.sqrt(counts + 1.0)) / mass[-1] * n, n - 1).astype(int)
    firsts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    return (*map(int, firsts), len(counts))


def start(shape: Shape, counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters before training: small random weights, biases at the log counts."""
    random = np.random.default_rng(seed)
    flat = np.zeros(shape.size, np.float32)
    p = shape.views(flat)
    p["embed"][:] = random.normal(0, 0.1, p["embed"].shape)
    p["input"][:] = random.normal(0, shape.embed ** -0.5, p["input"].shape)
    p["recur"][:] = random.normal(0, shape.hidden ** -0.5, p["recur"].shape)
    h = shape.hidden
    p["input_bias"][h:2 * h] = 1.0  # keep the state at first
    log = np.log(counts + 0.1)
    p["word_bias"][:] = log
    for c in range(shape.classes):
        p["class_bias"][c] = np.logaddexp.reduce(log[shape.firsts[c]:shape.firsts[c + 1]])
    return flat


def _by_class(shape: Shape, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every target, positions in class order, and where each class begins (classes + 1)."""
    of = np.searchsorted(shape.firsts, targets, "right") - 1
    order = np.argsort(of, kind="stable")
    return of, order, np.searchsorted(of[order], np.arange(shape.classes + 1))


def log_probabilities(shape: Shape, p: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state."""
    of, order, cut = _by_class(shape, targets)
    states, targets, of = states[order], targets[order], of[order]  # in class order: a class is a slice

    def of_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(at)), at]
        return own - np.log(np.exp(logits).sum(axis=1))
    logits = states @ p["to_class"]
    logits += p["class_bias"]
    logs = of_softmax(logits, of).astype(np.float64)
    for c in np.flatnonzero(np.diff(cut)):
        rows, a, b = slice(cut[c], cut[c + 1]), shape.firsts[c], shape.firsts[c + 1]
        logs[rows] += of_softmax(states[rows] @ p["to_word"][a:b].T + p["word_bias"][a:b], targets[rows] - a)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def document_scores(shape: Shape, flat: np.ndarray, ids: np.ndarray, firsts: np.ndarray, end: int, window: int = 64) -> np.ndarray:
    """Natural log likelihood of whole documents: each id given all earlier ones of its document.

    Documents run side by side, longest first, window by window; a document's state is carried from
    window to window to its end, so its length has no bound. Only a window's states are kept.
    """
    p = shape.views(flat)
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    begin, length = firsts[:-1][order], lengths[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    table, recur = p["embed"] @ p["input"] + p["input_bias"], p["recur"].copy()
    h = shape.hidden
    table[:, :2 * h] *= 0.5  # a gate is (1 + tanh(x / 2)) / 2
    recur[:, :2 * h] *= 0.5
    h, total = shape.hidden, np.zeros(len(order))
    state = np.zeros((len(order), h), np.float32)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        if held:
            rows = np.concatenate([np.arange(len(s)) for s, _ in held])
            logs = log_probabilities(shape, p, np.concatenate([s for s, _ in held]), np.concatenate([t for _, t in held]))
            total[:] += np.bincount(rows, weights=logs, minlength=len(total))
            held.clear()
    before, size = None, 0
    for t, n in enumerate(active):
        now = ids[begin[:n] + t]
        x = table[np.full(n, end) if before is None else before[:n]]
        old = state[:n]
        state = _gates(x, old @ recur, old, p["recur_bias"], h)[3]
        held.append((state, now))
        before, size = now, size + n
        if size >= window * 512:
            settle()
            size = 0
    settle()
    out = np.zeros(len(order))
    out[order] = total
    return out


def _gates(x: np.ndarray, g: np.ndarray, old: np.ndarray, bias: np.ndarray, h: int):
    """Gates, recurrent part, candidate and next state of one step, of inputs whose gate columns are halved."""
    # results get arrays of their own: in place, numpy leaves its vector code
    halves = x[:, :2 * h] + g[:, :2 * h]
    gates = np.tanh(halves)
    gates += 1.0
    gates *= 0.5
    pre = g[:, 2 * h:] + bias
    inner = pre * gates[:, :h]
    inner += x[:, 2 * h:]
    new = np.tanh(inner)
    state = old - new
    state *= gates[:, h:]
    state += new
    return gates, pre, new, state


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    into[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def window_gradient(shape: Shape, flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray,
                    end: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss of a window (steps x streams), its gradient, and the state after it.

    Backpropagation stops at the window's first step; a state is zero where the input ends a document.
    """
    p = shape.views(flat)
    grad = np.zeros_like(flat)
    q = shape.views(grad)
    steps, streams = inputs.shape
    h = shape.hidden
    embedded = p["embed"][inputs.reshape(-1)]
    x = (embedded @ p["input"] + p["input_bias"]).reshape(steps, streams, 3 * h)
    half = np.ones(3 * h, flat.dtype)
    half[:2 * h] = 0.5  # a gate is (1 + tanh(x / 2)) / 2
    x *= half
    recur = p["recur"] * half
    keep = (inputs != end).astype(flat.dtype)[:, :, None]
    kept = np.empty((4, steps, streams, h), flat.dtype)  # states before, recurrent parts, candidates, states after
    olds, pres, news, states = kept
    gates = np.empty((steps, streams, 2 * h), flat.dtype)
    for t in range(steps):
        np.multiply(state, keep[t], out=olds[t])
        gates[t], pres[t], news[t], state = _gates(x[t], olds[t] @ recur, olds[t], p["recur_bias"], h)
        states[t] = state
    flat_targets = targets.reshape(-1)
    of, order, cut = _by_class(shape, flat_targets)
    # in class order: a class is a slice
    seen, words, of = states.reshape(-1, h)[order], flat_targets[order], of[order]

    def softmax_gradient(logits: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss of the rows' columns ``at``, and its derivatives by the logits."""
        logits -= logits.max(axis=1, keepdims=True)
        out = np.exp(logits)
        out /= out.sum(axis=1, keepdims=True)
        row = np.arange(len(at))
        lost = -float(np.log(out[row, at] + 1e-30).sum())
        out[row, at] -= 1
        return lost, out
    loss, logits = softmax_gradient(seen @ p["to_class"] + p["class_bias"], of)
    q["to_class"][:] = seen.T @ logits
    q["class_bias"][:] = logits.sum(axis=0)
    d_seen = logits @ p["to_class"].T
    for c in np.flatnonzero(np.diff(cut)):
        rows, a, b = slice(cut[c], cut[c + 1]), shape.firsts[c], shape.firsts[c + 1]
        lost, own = softmax_gradient(seen[rows] @ p["to_word"][a:b].T + p["word_bias"][a:b], words[rows] - a)
        loss += lost
        q["to_word"][a:b] = own.T @ seen[rows]
        q["word_bias"][a:b] = own.sum(axis=0)
        d_seen[rows] += own @ p["to_word"][a:b]
    d_states = np.empty_like(d_seen)
    d_states[order] = d_seen
    d_states = d_states.reshape(steps, streams, h)
    # what does not depend on the steps after, for all steps at once
    r, z = gates[:, :, :h], gates[:, :, h:]
    to_new = (1 - z) * (1 - news * news)
    to_z = (olds - news) * z * (1 - z)
    to_r = pres * r * (1 - r)
    d_g = np.empty((steps, streams, 3 * h), flat.dtype)
    d_x = np.empty_like(d_g)
    back, turned = np.zeros((streams, h), flat.dtype), p["recur"].T.copy()
    for t in range(steps - 1, -1, -1):
        d = d_states[t] + back
        d_new = d_x[t, :, 2 * h:]
        np.multiply(d, to_new[t], out=d_new)
        np.multiply(d_new, to_r[t], out=d_g[t, :, :h])
        np.multiply(d, to_z[t], out=d_g[t, :, h:2 * h])
        np.multiply(d_new, r[t], out=d_g[t, :, 2 * h:])
        back = d_g[t] @ turned
        d *= z[t]
        back += d
        back *= keep[t]
    d_x[:, :, :2 * h] = d_g[:, :, :2 * h]
    d_g = d_g.reshape(-1, 3 * h)
    q["recur"][:] = olds.reshape(-1, h).T @ d_g
    q["recur_bias"][:] = d_g[:, 2 * h:].sum(axis=0)
    d_x = d_x.reshape(-1, 3 * h)
    q["input"][:] = embedded.T @ d_x
    q["input_bias"][:] = d_x.sum(axis=0)
    _scatter(q["embed"], inputs.reshape(-1), d_x @ p["input"].T)
    return loss, grad, state


def train(shape: Shape, flat: np.ndarray, ids: np.ndarray, end: int, rate: float, window: int = 24,
          updates: int = 100, most_streams: int = 256) -> np.ndarray:
    """Parameters after one pass over the ids of whole documents, each closed by ``end``.

    The ids are laid out in parallel streams, as many as leave about ``updates`` windows at least; every
    id is a target once. Steps are Adam's, with the gradient's norm clipped.
    """
    streams = int(min(max(len(ids) // (window * updates), 1), most_streams))
    length = -(-len(ids) // streams)
    inputs = np.concatenate([[end], ids[:-1]])
    lay = np.full((2, streams * length), end, ids.dtype)
    lay[0, :len(ids)], lay[1, :len(ids)] = inputs, ids
    inputs, targets = lay.reshape(2, streams, length).transpose(0, 2, 1)
    flat = flat.copy()
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    state = np.zeros((streams, shape.hidden), np.float32)
    for k, t in enumerate(range(0, length, window)):
        now_in, now_out = np.ascontiguousarray(inputs[t:t + window]), np.ascontiguousarray(targets[t:t + window])
        _, grad, state = window_gradient(shape, flat, now_in, now_out, state, end)
        grad /= now_in.size
        norm = float(np.sqrt(grad @ grad))
        if norm > 1.0:
            grad /= norm
        mean *= 0.9
        square *= 0.99
        np.multiply(grad, 0.1, out=step)
        mean += step
        np.multiply(grad, grad, out=step)
        step *= 0.01
        square += step
        np.multiply(square, 1 / (1 - 0.99 ** (k + 1)), out=step)
        np.sqrt(step, out=step)
        step += 1e-6
        np.divide(mean, step, out=step)
        step *= rate / (1 - 0.9 ** (k + 1))
        flat -= step
    return flat
