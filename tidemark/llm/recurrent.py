"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable
from pathlib import Path

import numpy as np

F32 = np.float32
#: Order of the parameters in a flat vector.
NAMES = ("embed", "w", "u", "b", "class_w", "class_b", "word_w", "word_b")


def one_thread() -> None:
    """Keep this process's matrix products on one thread: they are small, and further threads of the library would spend a core on waiting."""
    for lib in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        limit = getattr(ctypes.CDLL(str(lib)), "scipy_openblas_set_num_threads64_", None)
        if limit is not None:
            limit(1)


def shapes(vocabulary: int, hidden: int, classes: int) -> dict[str, tuple]:
    return {"embed": (vocabulary, hidden), "w": (hidden, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "class_w": (hidden, classes), "class_b": (classes,), "word_w": (vocabulary, hidden), "word_b": (vocabulary,)}


def class_starts(counts: np.ndarray, classes: int) -> np.ndarray:
    """First word of each class, words being in order of frequency: each class holds about as much of the sum of root frequencies."""
    root = np.sqrt(counts.astype(np.float64) + 0.5)
    place = np.minimum((np.cumsum(root) - root) / root.sum() * classes, classes - 1).astype(np.int64)
    starts = np.searchsorted(place, np.unique(place))
    return np.append(starts, len(counts))


def _exp(w: np.ndarray, bounded: bool) -> np.ndarray | F32:
    """exp of w in its place, after taking each row's maximum away where its range is not known to be small; returns what was taken away."""
    if bounded:
        np.exp(w, out=w)
        return F32(0)
    top = w.max(1, keepdims=True)
    w -= top
    np.exp(w, out=w)
    return top


def _sums(w: np.ndarray) -> np.ndarray:
    """Sums of the rows, as a column."""
    return w @ np.ones((w.shape[1], 1), w.dtype)


class Model:
    """Words 0..V-1 in order of frequency; class k holds words starts[k]..starts[k + 1] - 1."""

    def __init__(self, counts: np.ndarray, hidden: int, classes: int, seed: int = 7):
        self.starts = class_starts(counts, classes)
        self.classes, self.hidden, self.vocabulary = len(self.starts) - 1, hidden, len(counts)
        # Two bytes, which numpy sorts by radix.
        self.of = np.repeat(np.arange(self.classes, dtype=np.uint16), np.diff(self.starts))
        rnd = np.random.default_rng(seed)
        p = (counts.astype(np.float64) + 0.5) / (counts.astype(np.float64) + 0.5).sum()
        by_class = np.add.reduceat(p, self.starts[:-1])
        self.p = {k: (rnd.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(F32) for k, s in shapes(self.vocabulary, hidden, self.classes).items()}
        # The corpus's own frequencies are where learning starts from.
        self.p["class_w"] *= F32(0.3)
        self.p["word_w"] *= F32(0.3)
        self.p["class_b"] = np.log(by_class).astype(F32)
        self.p["word_b"] = np.log(p / by_class[self.of]).astype(F32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in shapes(self.vocabulary, self.hidden, self.classes).items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(F32)
            at += n

    def forward(self, table: np.ndarray, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """x: (T, B) previous words, fresh: where a text begins (state 0 there); returns states (T, B, H), the last state, and what backward needs."""
        n, (t_all, b) = self.hidden, x.shape
        states = np.empty((t_all, b, n), F32)
        # State before, both gates, candidate, and the state's part of the candidate before its gate.
        saved = (np.empty((t_all, b, n), F32), np.empty((t_all, b, 2 * n), F32), np.empty((t_all, b, n), F32), np.empty((t_all, b, n), F32)) if keep else None
        # A gate is (1 + tanh(half of its sum)) / 2; the halves are taken once.
        half, u, gx, starts = F32(0.5), self.p["u"].copy(), table[x], fresh.any(1)
        u[:, : 2 * n] *= half
        gx[..., : 2 * n] *= half
        g, zr_t, c_t = np.empty((b, 3 * n), F32), np.empty((b, 2 * n), F32), np.empty((b, n), F32)
        for t in range(t_all):
            if starts[t]:
                h = h * ~fresh[t][:, None]
            np.matmul(h, u, out=g)
            a = gx[t]
            zr = saved[1][t] if keep else zr_t
            np.add(g[:, : 2 * n], a[:, : 2 * n], out=zr)
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            c = saved[2][t] if keep else c_t
            np.multiply(zr[:, n:], g[:, 2 * n :], out=c)
            c += a[:, 2 * n :]
            np.tanh(c, out=c)
            new = states[t]
            np.subtract(h, c, out=new)
            new *= zr[:, :n]
            new += c
            if keep:
                saved[0][t], saved[3][t] = h, g[:, 2 * n :]
            h = new
        return states, h, saved

    def table(self) -> np.ndarray:
        return self.p["embed"] @ self.p["w"] + self.p["b"]

    def bounded(self) -> bool:
        """No logit is beyond 60 either way, as states are within -1 and 1."""
        p = self.p
        return bool((np.abs(p["word_w"]).sum(1) + np.abs(p["word_b"])).max() < 60 and (np.abs(p["class_w"]).sum(0) + np.abs(p["class_b"])).max() < 60)

    def log_probs(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the words y after the states (N, H)."""
        p = self.p
        k, each, bounded = self.of[y], np.arange(len(y)), self.bounded()
        logits = states @ p["class_w"]
        logits += p["class_b"]
        out = logits[each, k]
        top = _exp(logits, bounded)
        out -= (np.log(_sums(logits)) + top)[:, 0]
        order = np.argsort(k, kind="stable")
        bounds = np.searchsorted(k[order], np.arange(self.classes + 1))
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.starts) > 1)):
            at = order[bounds[c] : bounds[c + 1]]
            s, e = self.starts[c], self.starts[c + 1]
            w = states[at] @ p["word_w"][s:e].T
            w += p["word_b"][s:e]
            own = w[each[: len(at)], y[at] - s]
            top = _exp(w, bounded)
            out[at] += own - (np.log(_sums(w)) + top)[:, 0]
        return out

    def slopes(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, on: np.ndarray, h: np.ndarray, window: int = 1 << 30):
        """Gradients of the mean loss over windows that follow one another (backpropagation stops at the start of each), the loss and the last
        state."""
        p, n = self.p, self.hidden
        words = x.reshape(-1)
        own = p["embed"][words]
        states, last, saved = self.forward(own @ p["w"] + p["b"], np.arange(len(words)).reshape(x.shape), fresh, h, keep=True)
        flat, yy, ok = states.reshape(-1, n), y.reshape(-1), on.reshape(-1)
        # In order of words, so that each class, and each word, is one slice.
        at_all = np.flatnonzero(ok)
        at_all = at_all[np.argsort(yy[at_all].astype(np.uint16), kind="stable")]
        hs, yy = flat[at_all], yy[at_all]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        total = F32(max(1, len(yy)))
        q = hs @ p["class_w"]
        q += p["class_b"]
        bounded = self.bounded()
        _exp(q, bounded)
        q /= _sums(q)
        k, each = self.of[yy], np.arange(len(yy))
        loss = -np.log(q[each, k] + 1e-30).sum()
        q[each, k] -= 1
        q /= total
        g["class_w"], g["class_b"] = hs.T @ q, q.sum(0)
        dh = q @ p["class_w"].T
        bounds = np.searchsorted(k, np.arange(self.classes + 1))
        inside = np.flatnonzero(np.diff(self.starts)[k] > 1)
        target = p["word_w"][yy[inside]]
        loss -= ((hs[inside] * target).sum(1) + p["word_b"][yy[inside]]).sum(dtype=np.float64)
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.starts) > 1)):
            lo, hi, s, e = bounds[c], bounds[c + 1], self.starts[c], self.starts[c + 1]
            mine, weights = hs[lo:hi], p["word_w"][s:e]
            w = mine @ weights.T
            w += p["word_b"][s:e]
            top = _exp(w, bounded)
            size = _sums(w)
            loss += float((top + np.log(size)).sum())
            w /= size * total
            g["word_w"][s:e], g["word_b"][s:e] = w.T @ mine, w.sum(0)
            dh[lo:hi] += w @ weights
        if len(inside):
            dh[inside] -= target / total
            firsts = np.flatnonzero(np.diff(yy[inside], prepend=-1))
            g["word_w"][yy[inside][firsts]] -= np.add.reduceat(hs[inside], firsts) / total
            g["word_b"] -= (np.bincount(yy[inside], minlength=self.vocabulary) / total).astype(F32)
        d_states = np.zeros_like(flat)
        d_states[at_all] = dh
        d_states = d_states.reshape(states.shape)
        before, zr, c, gc = saved
        z, r = zr[..., :n], zr[..., n:]
        # What a state's gradient is multiplied by for the update gate, the reset gate and the candidate.
        to_c = (1 - z) * (1 - c * c)
        slope = np.empty((*x.shape, 3, n), F32)
        np.subtract(before, c, out=slope[:, :, 0])
        slope[:, :, 0] *= z * (1 - z)
        np.multiply(to_c, r, out=slope[:, :, 2])
        np.multiply(slope[:, :, 2], gc * (1 - r), out=slope[:, :, 1])
        d_next, ut = np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        dg, d_all = np.empty((*x.shape, 3 * n), F32), np.empty(states.shape, F32)
        ends = fresh.any(1)
        for t in range(len(x) - 1, -1, -1):
            d = np.add(d_states[t], d_next, out=d_all[t])
            np.multiply(d[:, None], slope[t], out=dg[t].reshape(len(d), 3, n))
            d_next = d * z[t] + dg[t] @ ut
            if t % window == 0:
                d_next = np.zeros_like(h)
            elif ends[t]:
                d_next *= ~fresh[t][:, None]
        g["u"] = before.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        dt = dg.reshape(-1, 3 * n)
        dt[:, 2 * n :] = (d_all * to_c).reshape(-1, n)
        g["w"] = own.T @ dt
        g["b"] = dt.sum(0)
        order = np.argsort(words.astype(np.uint16), kind="stable")
        firsts = np.flatnonzero(np.diff(words[order], prepend=-1))
        g["embed"][words[order][firsts]] = np.add.reduceat((dt @ p["w"].T)[order], firsts)
        return g, float(loss), last


class Adam:
    def __init__(self, model: Model, rate: float):
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.rate, self.t = rate, 0

    def step(self, model: Model, g: dict, weight: float = 1.0) -> None:
        """``weight``: the share of a whole step that this one is; averages and weights move by so much less."""
        self.t += weight
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        cut = F32(min(1.0, 1.0 / (norm + 1e-12)))
        rate = weight * self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * cut
            m, v = self.m[k], self.v[k]
            m += F32(1 - 0.9**weight) * (x - m)
            np.multiply(x, x, out=x)
            x -= v
            x *= F32(1 - 0.999**weight)
            v += x
            np.sqrt(v, out=x)
            x += F32(1e-8)
            np.divide(m, x, out=x)
            x *= F32(rate)
            model.p[k] -= x


def score(model: Model, table: np.ndarray, docs: list[np.ndarray], lanes: int = 256, window: int = 64, first: int = 0) -> list[np.ndarray]:
    """Log probability of each word of each document, the end included; documents: word ids with the end last; ``first``: the id before a
    document's first word, that of the end.

    Documents share lanes, longest first into the shortest lane; the state runs on across windows and starts anew with each document.
    Lanes stand longest first, so those still running are the first ones.
    """
    import heapq

    queue = [(0, i) for i in range(min(lanes, len(docs)))]
    held: list[list[int]] = [[] for _ in queue]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, lane = heapq.heappop(queue)
        held[lane].append(d)
        heapq.heappush(queue, (n + len(docs[d]), lane))
    order = sorted(held, key=lambda own: -sum(len(docs[d]) for d in own))
    streams = [np.concatenate([docs[d] for d in own]) for own in order]
    length = np.array([len(s) for s in streams])
    y = np.zeros((len(streams), length[0]), np.int32)
    fresh = np.zeros(y.shape, bool)
    for i, (own, s) in enumerate(zip(order, streams, strict=True)):
        y[i, : len(s)] = s
        fresh[i, np.cumsum([0, *(len(docs[d]) for d in own[:-1])])] = True
    x = np.zeros_like(y)
    x[:, 1:] = y[:, :-1]
    x[fresh] = first
    out = np.zeros(y.shape, F32)
    h = np.zeros((len(streams), model.hidden), F32)
    e = 0
    while e < y.shape[1]:
        t, b = e, int((length > e).sum())
        # Where few lanes still run, longer windows make up for them.
        e = min(t + window * max(1, lanes // (4 * b)), y.shape[1])
        states, h, _ = model.forward(table, np.ascontiguousarray(x[:b, t:e].T), np.ascontiguousarray(fresh[:b, t:e].T), h[:b])
        on = np.arange(t, e)[:, None] < length[:b][None]
        flat = states[on]
        got = np.zeros(on.shape, F32)
        got[on] = model.log_probs(flat, np.ascontiguousarray(y[:b, t:e].T)[on])
        out[:b, t:e] = got.T
    result: list = [None] * len(docs)
    for i, own in enumerate(order):
        at = 0
        for d in own:
            result[d] = out[i, at : at + len(docs[d])]
            at += len(docs[d])
    return result


def train(model: Model, optimiser: Adam, docs: Iterable[np.ndarray], lanes: int = 128, window: int = 32, first: int = 0) -> tuple[float, int]:
    """One step for each window of ``lanes`` running documents, until every word of every document has been in one; documents: word ids with
    the end last.  Returns the summed loss and the number of words.

    A lane's state runs on from window to window (backpropagation stops at a window's start) and starts anew with each document, which follows
    the one before it in its lane at once.  Where few lanes still run, their windows' gradients are added up to a quarter of a whole step, and
    a step weighs as much as it has words, so that words weigh alike.
    """
    docs, loss, words, whole = iter(docs), 0.0, 0, lanes * window
    sums, waiting = None, 0
    none = np.zeros(0, np.int32)
    held = [(none, 0)] * lanes
    h, before = np.zeros((lanes, model.hidden), F32), np.zeros(lanes, np.int32)
    while True:
        # Windows that would wait for others before a step are taken together, as the weights stand still between them.
        span = window * max(1, lanes // (4 * len(held)))
        y = np.zeros((len(held), span), np.int32)
        fresh, n = np.zeros(y.shape, bool), np.zeros(len(held), np.int64)
        for j, (d, i) in enumerate(held):
            at = 0
            while at < span:
                while d is not None and i == len(d):
                    d, i = next(docs, None), 0
                if d is None:
                    d, i = none, 0
                    break
                if not i:
                    fresh[j, at] = True
                k = min(span - at, len(d) - i)
                y[j, at : at + k] = d[i : i + k]
                at, i = at + k, i + k
            held[j], n[j] = (d, i), at
        x = np.empty_like(y)
        x[:, 0], x[:, 1:] = before, y[:, :-1]
        x[fresh] = first
        live = np.flatnonzero(n)
        if not len(live):
            if waiting:
                optimiser.step(model, {k: v / F32(waiting) for k, v in sums.items()}, waiting / whole)
            return loss, words
        held, size, before = [held[j] for j in live], int(n.max()), y[live, -1]
        x, y, fresh = (np.ascontiguousarray(v[live, :size].T) for v in (x, y, fresh))
        on = np.arange(size)[:, None] < n[live]
        g, part, h = model.slopes(x, y, fresh, on, h[live], window)
        some = int(on.sum())
        loss, words = loss + part, words + some
        if waiting or 4 * some < whole:
            sums = {k: v * F32(some) + (sums[k] if waiting else 0) for k, v in g.items()}
            waiting += some
            if 4 * waiting < whole:
                continue
            g, some = {k: v / F32(waiting) for k, v in sums.items()}, waiting
            waiting = 0
        optimiser.step(model, g, some / whole)
