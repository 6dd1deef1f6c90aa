"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, states carried over windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

F32 = np.float32


@dataclass
class Gru:
    """Word ids 0..n-1; id n is the word outside the list, a class of its own.

    x: input table (n + 1, 3H), a word's embedding already projected on the three gates; u, ub: recurrent weights and bias;
    c, cb: class softmax; w, wb: per class the softmax over its words.
    """

    x: np.ndarray
    u: np.ndarray
    ub: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray
    per_class: int
    names: tuple[str, ...] = field(default=("x", "u", "ub", "c", "cb", "w", "wb"), repr=False)

    @classmethod
    def start(cls, counts: np.ndarray, outside: float, hidden: int, per_class: int, seed: int = 11) -> Gru:
        """The unigram model of the counts, frequent words first, with small random gates."""
        rng = np.random.default_rng(seed)
        n = len(counts)
        k = -(-n // per_class)
        share = np.zeros(k * per_class)
        share[:n] = counts + 0.5
        share = share.reshape(k, per_class)
        mass = np.append(share.sum(axis=1), outside)
        norm = lambda *s: rng.normal(0, 0.1, s).astype(F32)
        with np.errstate(divide="ignore"):
            wb = np.maximum(np.log(share / share.sum(axis=1, keepdims=True)), -1e4)
        return cls(norm(n + 1, 3 * hidden), norm(hidden, 3 * hidden), np.zeros(3 * hidden, F32), np.zeros((hidden, k + 1), F32), np.log(mass / mass.sum()).astype(F32), np.zeros((k, hidden, per_class), F32), wb.astype(F32), per_class)

    @property
    def hidden(self) -> int:
        return self.u.shape[0]

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, a).ravel() for a in self.names])

    def with_vector(self, v: np.ndarray) -> Gru:
        out, i = {}, 0
        for a in self.names:
            old = getattr(self, a)
            out[a] = v[i : i + old.size].reshape(old.shape).astype(F32)
            i += old.size
        return Gru(**out, per_class=self.per_class)

    def step(self, h: np.ndarray, x: np.ndarray, g: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
        """One step from states h and the words' inputs x; columns are slots. g takes both gates and the recurrent part of the
        candidate, n the candidate and new the new states."""
        m = self.hidden
        np.matmul(self.u.T, h, out=g)
        g += self.ub[:, None]
        zr = g[: 2 * m]
        zr += x[: 2 * m]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(g[m : 2 * m], g[2 * m :], out=n)
        n += x[2 * m :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= g[:m]
        new += n

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """(T, 3H, S) rows of x of a window's ids (S, T)."""
        return np.ascontiguousarray(self.x.take(ids.T, axis=0).transpose(0, 2, 1))

    def states(self, h: np.ndarray, ids: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (H, T * S) before each step of a window (S, T) and the last one (H, S); a fresh place starts from zero."""
        s, t_max = ids.shape
        out = np.empty((t_max + 1, self.hidden, s), F32)
        out[0] = h
        x, g, n = self.inputs(ids), np.empty((3 * self.hidden, s), F32), np.empty((self.hidden, s), F32)
        begins = fresh.any(axis=0)
        for t in range(t_max):
            if begins[t]:
                out[t][:, fresh[:, t]] = 0
            self.step(out[t], x[t], g, n, out[t + 1])
        return _flat(out[:t_max]), out[t_max]

    def _classes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each id, their order by class, and where each class begins in it."""
        cls = ids // self.per_class
        cls[ids == len(self.x) - 1] = len(self.w)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(len(self.w) + 1))

    def log_prob(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id given the state before it, a row of h."""
        cls, order, edge = self._classes(ids)
        h = h.T
        logits = self.c.T @ h
        logits += self.cb[:, None]
        logits -= logits.max(axis=0)
        out = logits[cls, np.arange(len(ids))]
        out -= np.log(np.exp(logits, out=logits).sum(axis=0))
        order = order[: edge[-1]]
        h, place, hit = h.take(order, axis=1), ids[order] % self.per_class, np.empty(len(order), F32)
        for k in range(len(self.w)):
            at = slice(edge[k], edge[k + 1])
            if at.stop > at.start:
                s = self.w[k].T @ h[:, at]
                s += self.wb[k][:, None]
                s -= s.max(axis=0)
                hit[at] = s[place[at], np.arange(at.stop - at.start)]
                hit[at] -= np.log(np.exp(s, out=s).sum(axis=0))
        out[order] += hit
        return out

    def gradients(self, h: np.ndarray, ids: np.ndarray, fresh: np.ndarray, real: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean loss over the real places of one window, back to its start only; the ids whose rows of x
        they are for, and the last state."""
        s, t_max = ids.shape
        m = self.hidden
        held, gates, n = np.empty((t_max + 1, m, s), F32), np.empty((t_max, 3 * m, s), F32), np.empty((t_max, m, s), F32)
        held[0] = h
        x, begins = self.inputs(ids), fresh.any(axis=0)
        for t in range(t_max):
            if begins[t]:
                held[t][:, fresh[:, t]] = 0
            self.step(held[t], x[t], gates[t], n[t], held[t + 1])
        before, h = held[:t_max], held[t_max]
        flat, target, weight = _flat(before), ids.T.ravel(), real.T.ravel().astype(F32)
        weight /= max(1.0, float(weight.sum()))
        g = {a: np.zeros_like(getattr(self, a)) for a in ("w", "wb")}
        cls, order, edge = self._classes(target)
        p = self.c.T @ flat
        p += self.cb[:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= weight / p.sum(axis=0)
        p[cls, np.arange(len(target))] -= weight
        g["c"], g["cb"] = flat @ p.T, p.sum(axis=1)
        back = self.c @ p
        order = order[: edge[-1]]
        here, place, w = flat.take(order, axis=1), target[order] % self.per_class, weight[order]
        more = np.empty_like(here)
        for k in range(len(self.w)):
            at = slice(edge[k], edge[k + 1])
            if at.stop > at.start:
                r = self.w[k].T @ here[:, at]
                r += self.wb[k][:, None]
                r -= r.max(axis=0)
                np.exp(r, out=r)
                r *= w[at] / r.sum(axis=0)
                r[place[at], np.arange(at.stop - at.start)] -= w[at]
                g["w"][k], g["wb"][k] = here[:, at] @ r.T, r.sum(axis=1)
                np.matmul(self.w[k], r, out=more[:, at])
        back[:, order] += more
        back = back.reshape(m, t_max, s)
        z, r, q = gates[:, :m], gates[:, m : 2 * m], gates[:, 2 * m :]
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (1 - z)
        to_r = q * r * (1 - r)
        du, dn = np.empty((t_max, 3 * m, s), F32), np.empty((t_max, m, s), F32)
        dh = np.zeros((m, s), F32)
        for t in range(t_max - 1, -1, -1):
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=du[t, :m])
            np.multiply(dn[t], to_r[t], out=du[t, m : 2 * m])
            np.multiply(dn[t], r[t], out=du[t, 2 * m :])
            dh *= z[t]
            dh += self.u @ du[t]
            dh += back[:, t]
            if begins[t]:
                dh[:, fresh[:, t]] = 0
        every = _flat(du)
        g["u"], g["ub"] = flat @ every.T, every.sum(axis=1)
        every[2 * m :] = _flat(dn)
        order = np.argsort(target.astype(np.uint16) if len(self.x) <= 1 << 16 else target, kind="stable")
        met = target[order]
        first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
        g["x"] = np.add.reduceat(every.take(order, axis=1), first, axis=1).T
        return g, met[first], h


def _flat(a: np.ndarray) -> np.ndarray:
    """(T, n, S) as (n, T * S)."""
    return np.ascontiguousarray(a.transpose(1, 0, 2)).reshape(a.shape[1], -1)


class Streams:
    """Documents dealt to slots of even length, one after the other, the longest slot first.

    Only the tokens are held, so a very long document costs its own length; windows take the slots that still have tokens.
    """

    def __init__(self, docs: list[np.ndarray], least: int = 16, most: int = 512):
        sizes = np.array([len(d) for d in docs])
        slots = int(np.clip(8 * sizes.sum() // max(1, sizes.max()), min(least, len(docs)), min(most, len(docs))))
        held: list[list[int]] = [[] for _ in range(slots)]
        fill = np.zeros(slots, np.int64)
        for k in np.argsort(-sizes, kind="stable"):
            s = int(fill.argmin())
            held[s].append(int(k))
            fill[s] += sizes[k]
        order = np.argsort(-fill, kind="stable")
        self.docs, self.fill = len(docs), fill[order]
        self.start = np.append(0, np.cumsum(self.fill)[:-1])
        dealt = [k for s in order for k in held[s]]
        self.ids = np.concatenate([docs[k] for k in dealt]).astype(np.int32)
        self.owner = np.repeat(np.array(dealt, np.int32), sizes[dealt])

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids, document of each place, whether it is its document's first, whether it is a place at all), each (slots, length)."""
        begins = np.append(True, self.owner[1:] != self.owner[:-1])
        begins[self.start[self.fill > 0]] = True
        for i in range(0, int(self.fill[0]), length):
            live = int(np.searchsorted(-self.fill, -i, side="left"))
            at = self.start[:live, None] + np.arange(i, i + length)
            real = np.arange(i, i + length) < self.fill[:live, None]
            at[~real] = 0
            yield self.ids[at], self.owner[at], begins[at] & real, real


def score(model: Gru, docs: list[np.ndarray], window: int = 64) -> np.ndarray:
    """Natural log probability of each whole document; the state goes from window to window."""
    if not sum(map(len, docs)):
        return np.zeros(len(docs))
    held = Streams(docs)
    h = np.zeros((model.hidden, len(held.fill)), F32)
    out = np.zeros(len(docs))
    for now, who, fresh, real in held.windows(window):
        before, h = model.states(h[:, : len(now)], now, fresh)
        real = real.T.ravel()
        p = model.log_prob(before[:, real].T, now.T.ravel()[real])
        out += np.bincount(who.T.ravel()[real], weights=p, minlength=len(docs))
    return out


def train(model: Gru, docs: list[np.ndarray], rate: float = 0.03, window: int = 32, slots: int = 128, clip: float = 1.0) -> Gru:
    """One pass of truncated backpropagation with Adam over all documents; the rate falls linearly.

    Long documents are learned in pieces, which start from an empty state each, so that slots are of even length to the end.

    Every fortieth document is kept back, and of the points on the way from the old weights to the new ones that score best on
    those is taken, so that few or odd documents can't make the model worse than it was. Those kept back are then learned in the
    same way, judged on as many of the others. A single document has nothing to judge it and is not learned.
    """
    held, used = docs[::40], [d for i, d in enumerate(docs) if i % 40]
    if not used:
        return model
    model = _judged(model, used, held, rate, window, slots, clip)
    return _judged(model, held, used[::39], rate, window, slots, clip)


def pieces(docs: list[np.ndarray], longest: int = 512) -> list[np.ndarray]:
    """The documents, those beyond `longest` tokens in parts of about even length."""
    return [p for d in docs for p in (np.array_split(d, -(-len(d) // longest)) if len(d) > longest else (d,))]


def _judged(model: Gru, used: list[np.ndarray], held: list[np.ndarray], rate: float, window: int, slots: int, clip: float) -> Gru:
    used, held = pieces(used), pieces(held)
    streams = Streams(used, 8, slots)
    old = model.vector()
    model = model.with_vector(old)
    h = np.zeros((model.hidden, len(streams.fill)), F32)
    first = {a: np.zeros_like(getattr(model, a)) for a in model.names}
    second = {a: np.zeros_like(getattr(model, a)) for a in model.names}
    total = -(-int(streams.fill[0]) // window)
    share = float(window * len(streams.fill))
    for k, (ids, _, fresh, real) in enumerate(streams.windows(window)):
        g, rows, h = model.gradients(h[:, : len(ids)], ids, fresh, real)
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = F32(min(1.0, clip / (norm + 1e-12)))
        # a window that few long documents still fill counts for less
        step = rate * (1 - k / total) * float(np.sqrt(real.sum() / share))
        for a, v in g.items():
            where = rows if a == "x" else slice(None)  # only the input rows that were met move
            v *= scale
            m1 = first[a][where] + F32(0.1) * (v - first[a][where])
            m2 = second[a][where] + F32(0.01) * (v * v - second[a][where])
            first[a][where], second[a][where] = m1, m2
            getattr(model, a)[where] -= F32(step / (1 - 0.9 ** (k + 1))) * m1 / (np.sqrt(m2 / F32(1 - 0.99 ** (k + 1))) + F32(1e-6))
    new = model.vector()
    ways = [model.with_vector(old + F32(f) * (new - old)) for f in (0.0, 0.5, 1.0)]
    return max(ways, key=lambda m: float(score(m, held).sum()))
