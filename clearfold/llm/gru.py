"""A gated recurrent language model in numpy with a class-factored softmax.

Tokens are codes: named words have a code of their own, all others share one per ending. A
code's probability is that of its class times that of the word within its class. Documents
run in lanes side by side; a lane carries its state from window to window and starts anew
with every document, so a long document is scored whole. Training is truncated
backpropagation through one window at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np

HIDDEN, EMBEDDED = 24, 16
PER_CLASS = 64  # named words of a class
WINDOW = 32
MAX_LANES = 256
ROWS = 1024  # rows of class logits at once, which stay in a core's cache
SCORED = 32_768  # states that the softmax takes at once in scoring
BLOCK = 16_384  # weights that one step of Adam takes at once
LN10 = float(np.log(10.0))


@dataclass
class Weights:
    E: np.ndarray  # code (and one for the start) to embedding
    W: np.ndarray  # embedding to the gates update, reset, candidate
    b: np.ndarray
    U: np.ndarray  # state to the gates
    C: np.ndarray  # state to classes
    c: np.ndarray
    K: np.ndarray  # class, state, word within the class
    k: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays()]).astype("<f4").tobytes()

    def like(self, data: bytes) -> Weights:
        """Weights of the same shapes from ``flat``."""
        return self.views(np.frombuffer(data, "<f4").astype(np.float32))

    def views(self, values: np.ndarray) -> Weights:
        """Weights of the same shapes that lie in ``values``, one after the other."""
        out, at = [], 0
        for a in self.arrays():
            out.append(values[at : at + a.size].reshape(a.shape))
            at += a.size
        return Weights(*out)


@dataclass(frozen=True)
class Codes:
    """What a code stands for: its class, and its place there (-1 for codes that are a class of their own kind)."""

    cls: np.ndarray
    place: np.ndarray
    n_named_classes: int


def initial(codes: Codes, class_share: np.ndarray, within: np.ndarray, seed: int = 5) -> Weights:
    """Weights that give every class and every word its share of the training tokens, whatever the state."""
    r = np.random.default_rng(seed)
    small = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    n, c = len(codes.cls) + 1, len(class_share)
    return Weights(
        small(n, EMBEDDED, scale=0.3), small(EMBEDDED, 3 * HIDDEN, scale=0.3), np.zeros(3 * HIDDEN, np.float32),
        small(HIDDEN, 3 * HIDDEN, scale=0.2), small(HIDDEN, c, scale=0.02), np.log(class_share).astype(np.float32),
        small(codes.n_named_classes, HIDDEN, PER_CLASS, scale=0.02), within.astype(np.float32),
    )


def lanes(lengths: Sequence[int]) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first."""
    total = sum(lengths)
    n = int(min(MAX_LANES, max(8, total // 4000), max(1, len(lengths))))
    heap = [(0, i, []) for i in range(n)]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        size, i, docs = heapq.heappop(heap)
        docs.append(d)
        heapq.heappush(heap, (size + lengths[d], i, docs))
    return [docs for _, _, docs in sorted(heap, key=lambda x: (-x[0], x[1])) if docs]


class Streams:
    """Documents laid out in lanes, as arrays of (time, lane)."""

    def __init__(self, docs: Sequence[np.ndarray], start: int):
        dealt = lanes([len(d) for d in docs])
        self.lengths = np.array([sum(len(docs[d]) for d in lane) for lane in dealt], np.int64)
        longest = int(self.lengths[0]) if dealt else 0
        self.target = np.zeros((longest, len(dealt)), np.uint16)
        self.before = np.zeros((longest, len(dealt)), np.int32)
        self.first = np.zeros((longest, len(dealt)), bool)
        self.doc = np.full((longest, len(dealt)), -1, np.int32)
        for i, lane in enumerate(dealt):
            at = 0
            for d in lane:
                n = len(docs[d])
                self.target[at : at + n, i] = docs[d]
                self.before[at, i], self.first[at, i] = start, True
                self.before[at + 1 : at + n, i] = docs[d][:-1]
                self.doc[at : at + n, i] = d
                at += n

    def windows(self):
        for t in range(0, len(self.target), WINDOW):
            live = int((self.lengths > t).sum())
            yield slice(t, t + WINDOW), live


class Space:
    """Arrays that are used again from window to window, by name; what one held is gone when it is asked for again."""

    def __init__(self):
        self.held = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


def _forward(w: Weights, before: np.ndarray, first: np.ndarray, h: np.ndarray, cached: bool = True, space: Space | None = None):
    """States after each step, what ``_backward`` needs (only if ``cached``), and the last state.

    Inside, lanes are the last axis, so that the rows of a gate lie together. The weights of the
    sigmoid gates are halved beforehand, as sigmoid(a) is tanh(a / 2) / 2 + 1 / 2.
    """
    space = space or Space()
    steps, n = before.shape
    kind, two = w.U.dtype, 2 * HIDDEN
    half = np.array([0.5] * two + [1.0] * HIDDEN, kind)
    incoming, bias, recurrent = np.ascontiguousarray((w.W * half).T), (w.b * half)[:, None], np.ascontiguousarray((w.U * half).T)
    x = space("x", (steps, n, EMBEDDED), kind)
    np.take(w.E, before, axis=0, out=x, mode="clip")
    keep = (~first).astype(kind)
    h, states = h.T, space("by_lane", (steps, n, HIDDEN), kind)
    g, left = space("g", (3 * HIDDEN, n), kind), space("left", (2, HIDDEN, n), kind)
    held = steps if cached else _few(n)
    gates, entered, reset = (space(name, (held, size * HIDDEN, n), kind) for name, size in (("gates", 3), ("entered", 1), ("reset", 1)))
    for t in range(steps):
        i = t if cached else t % held
        if t % _few(n) == 0:
            part = gates[i : i + _few(n)][: steps - t]
            np.matmul(incoming, x[t : t + len(part)].transpose(0, 2, 1), out=part)
            part += bias
        zr, new, p, rg = gates[i, :two], gates[i, two:], entered[i], reset[i]
        np.multiply(h, keep[t], out=p)
        np.matmul(recurrent, p, out=g)
        zr += g[:two]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[HIDDEN:], g[two:], out=rg)
        new += rg
        np.tanh(new, out=new)
        h = left[t % 2]
        np.subtract(p, new, out=h)
        h *= zr[:HIDDEN]
        h += new
        states[t] = h.T
    return states, (x, keep, entered, gates, reset) if cached else None, h.T.copy()


def _few(n: int) -> int:
    """Steps of ``n`` lanes whose arrays stay in a core's cache."""
    return max(1, min(WINDOW, ROWS // max(1, n)))


def _softmax(s: np.ndarray, weights: np.ndarray, bias: np.ndarray, factor: np.ndarray | None, target: np.ndarray):
    """Logit of the target, sum of all exponentials, and the exponentials but for ``factor``, which multiplies each column."""
    p = s @ weights
    own = p[np.arange(len(s)), target]
    if factor is None:  # logits may be large: the bias is added, and above 60 they are held there, far from overflow
        p += bias
        np.minimum(p, 60, out=p)
        np.exp(p, out=p)
        return own + bias[target], p.sum(axis=1), p
    np.exp(p, out=p)
    return own + bias[target], p @ factor, p


def _factors(weights: np.ndarray, bias: np.ndarray) -> list[np.ndarray | None]:
    """Exponentials of the biases of each softmax; None where logits may leave (-60, 60), as no part of a state is beyond 1."""
    plain = (np.abs(weights).sum(axis=1).max(axis=1) < 59) & (np.abs(bias).max(axis=1) < 59)
    with np.errstate(over="ignore"):
        return [f if small else None for f, small in zip(np.exp(bias), plain.tolist())]


def _add_gradient(s, p, total, live, factor, bias, target, weights, to_weights, to_bias, to_states) -> None:
    """Adds the gradients of a softmax to those of its weights, and writes that of the states; ``p`` is used up.

    Rows of ``p`` lack the division by their total and columns their factor: both are made up for on the narrow results.
    """
    factor = np.ones_like(bias) if factor is None else factor
    p[np.arange(len(s)), target] -= total / factor[target]
    share = live / total
    turned = np.empty(s.shape[::-1], s.dtype)
    np.multiply(s.T, share, out=turned)
    to_weights += (turned @ p) * factor
    to_bias += (share @ p) * factor
    np.matmul(p, (weights * factor).T, out=to_states)
    to_states *= share[:, None]


def _output(w: Weights, codes: Codes, states: np.ndarray, target: np.ndarray, live: np.ndarray, gradient: Weights | None):
    """Natural log-probability of each target code; with ``gradient``, adds to it and returns that of the states."""
    cls, place = codes.cls.take(target), codes.place.take(target)
    own, total = np.empty(len(target), states.dtype), np.empty(len(target), states.dtype)
    back = None if gradient is None else np.empty_like(states)
    factor = _factors(w.C[None], w.c[None])[0]
    for at in range(0, len(target), ROWS):
        part = slice(at, at + ROWS)
        own[part], total[part], p = _softmax(states[part], w.C, w.c, factor, cls[part])
        if gradient is not None:
            _add_gradient(states[part], p, total[part], live[part], factor, w.c, cls[part], w.C, gradient.C, gradient.c, back[part])
    logp = own - np.log(total)
    named = np.flatnonzero((place >= 0) & (live > 0))
    if not len(named):
        return logp, back
    named = named[_order(cls[named], codes.n_named_classes)]
    ends = np.searchsorted(cls[named], np.arange(codes.n_named_classes + 1))
    inner, place, ones = states.take(named, axis=0), place[named], live[named]
    own, total = np.empty(len(named), states.dtype), np.empty(len(named), states.dtype)
    inner_back = None if gradient is None else np.empty_like(inner)
    factors = _factors(w.K, w.k)
    for k in np.flatnonzero(np.diff(ends)).tolist():
        end = int(ends[k + 1])
        for at in range(int(ends[k]), end, ROWS):
            part = slice(at, min(at + ROWS, end))
            own[part], total[part], p = _softmax(inner[part], w.K[k], w.k[k], factors[k], place[part])
            if gradient is not None:
                _add_gradient(inner[part], p, total[part], ones[part], factors[k], w.k[k], place[part], w.K[k], gradient.K[k], gradient.k[k], inner_back[part])
    logp[named] += own - np.log(total)
    if gradient is not None:
        back[named] += inner_back
    return logp, back


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys up to ``most``; keys of 16 bits are sorted by counting."""
    return np.argsort(keys.astype(np.uint16) if most < 2**16 else keys, kind="stable")


def score(w: Weights, codes: Codes, docs: Sequence[np.ndarray]) -> np.ndarray:
    """log10 probability of the codes of each document, given its own beginning only."""
    out = np.zeros(len(docs))
    s = Streams(docs, len(codes.cls))
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    space, size, most = Space(), 0, SCORED + WINDOW * MAX_LANES
    states, target, doc = np.empty((most, HIDDEN), np.float32), np.empty(most, np.uint16), np.empty(most, np.int32)
    ones = np.ones(most, np.float32)
    for window, n in s.windows():
        of = s.doc[window, :n].ravel()
        new, _, h = _forward(w, s.before[window, :n], s.first[window, :n], h[:n], cached=False, space=space)
        live = np.flatnonzero(of >= 0)
        part = slice(size, size + len(live))
        states[part] = new.reshape(-1, HIDDEN).take(live, axis=0)
        target[part], doc[part] = s.target[window, :n].ravel()[live], of[live]
        size += len(live)
        if size >= SCORED or window.stop >= len(s.target):
            logp, _ = _output(w, codes, states[:size], target[:size], ones[:size], None)
            out += np.bincount(doc[:size], logp.astype(np.float64), len(docs))
            size = 0
    return out / LN10


def _backward(w: Weights, g: Weights, before: np.ndarray, cache, back: np.ndarray, space: Space | None = None) -> None:
    """Adds the gradients of the recurrence to ``g``, given that of the states; ``cache`` is used up."""
    space = space or Space()
    x, keep, entered, gates, reset = cache
    steps, n = before.shape
    kind, two, few = w.U.dtype, 2 * HIDDEN, _few(before.shape[1])
    turned = np.concatenate([w.U[:, two:], w.U[:, :two]], axis=1)
    dh, through = np.zeros((HIDDEN, n), kind), np.empty((HIDDEN, n), kind)
    dx = space("dx", (steps, n, EMBEDDED), kind)
    for end in range(steps, 0, -few):
        part = slice(max(0, end - few), end)
        p, z, r, new, to_r = entered[part], gates[part, :HIDDEN], gates[part, HIDDEN:two], gates[part, two:], reset[part]
        to_z, rest, by_row = (space(name, p.shape, kind) for name in ("to_z", "rest", "by_row"))
        np.subtract(1, r, out=rest)
        to_r *= rest
        np.subtract(1, z, out=rest)
        np.subtract(p, new, out=to_z)
        to_z *= z
        to_z *= rest
        new *= new
        to_n = np.subtract(1, new, out=new)
        to_n *= rest
        by_row[...] = back[part].transpose(0, 2, 1)
        d = space("d", (len(p), 4 * HIDDEN, n), kind)  # by the state's part of the candidate, then by update, reset, candidate
        for t in range(len(p) - 1, -1, -1):
            dt = d[t]
            dn = dt[3 * HIDDEN :]
            dh += by_row[t]
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dn, r[t], out=dt[:HIDDEN])
            np.multiply(dh, to_z[t], out=dt[HIDDEN:two])
            np.multiply(dn, to_r[t], out=dt[two : 3 * HIDDEN])
            np.matmul(turned, dt[: 3 * HIDDEN], out=through)
            dh *= z[t]
            dh += through
            dh *= keep[part.start + t]
        by_gate = d[:, HIDDEN:].transpose(0, 2, 1)
        u = np.matmul(p, d[:, : 3 * HIDDEN].transpose(0, 2, 1)).sum(axis=0)
        g.U[:, :two] += u[:, HIDDEN:]
        g.U[:, two:] += u[:, :HIDDEN]
        g.W += np.matmul(x[part].transpose(0, 2, 1), by_gate).sum(axis=0)
        g.b += d[:, HIDDEN:].sum(axis=2).sum(axis=0)
        np.matmul(by_gate, w.W.T, out=dx[part])
    dx, rows = dx.reshape(-1, EMBEDDED), before.ravel()
    order = _order(rows, len(w.E))
    where = np.flatnonzero(np.diff(rows[order], prepend=-1))
    if len(where):
        g.E[rows[order][where]] += np.add.reduceat(dx[order], where, axis=0)


def _adam(weights: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, step: int, tokens: float) -> None:
    """One step of Adam in place, block by block; ``g`` is used up."""
    at_first, at_second = rate / (1 - 0.9**step), 1 / (1 - 0.99**step)
    spare = np.empty(min(BLOCK, len(g)), g.dtype)
    for at in range(0, len(g), BLOCK):
        a, d, m, v = (x[at : at + BLOCK] for x in (weights, g, first, second))
        s = spare[: len(a)]
        d /= tokens
        np.subtract(d, m, out=s)
        s *= 0.1
        m += s
        d *= d
        d -= v
        d *= 0.01
        v += d
        np.multiply(v, at_second, out=s)
        np.sqrt(s, out=s)
        s += 1e-6
        np.multiply(m, at_first, out=d)
        d /= s
        a -= d


def train(w: Weights, codes: Codes, docs: Sequence[np.ndarray], rate: float) -> int:
    """One pass of truncated backpropagation with Adam over the documents, in place; returns the tokens seen."""
    s = Streams(docs, len(codes.cls))
    h = np.zeros((len(s.lengths), HIDDEN), np.float32)
    values = np.concatenate([a.ravel() for a in w.arrays()])
    moving, gradient = w.views(values), np.empty_like(values)
    g = w.views(gradient)
    first, second = np.zeros_like(values), np.zeros_like(values)
    space, seen, step = Space(), 0, 0
    for window, n in s.windows():
        before, doc = s.before[window, :n], s.doc[window, :n]
        states, cache, h = _forward(moving, before, s.first[window, :n], h[:n], space=space)
        live = (doc >= 0).ravel().astype(np.float32)
        gradient.fill(0)
        _, back = _output(moving, codes, states.reshape(-1, HIDDEN), s.target[window, :n].ravel(), live, g)
        _backward(moving, g, before, cache, back.reshape(states.shape), space)
        tokens = max(1.0, float(live.sum()))
        step += 1
        seen += int(tokens)
        _adam(values, gradient, first, second, rate, step, tokens)
    for a, b in zip(w.arrays(), moving.arrays()):
        a[...] = b
    return seen
