"""A gated recurrent language model in numpy, with a class-factored output softmax.

The ``HEAD`` most frequent words and the end token are predicted as class times word within class, the classes being equal
shares of the roots of their counts. All other words are in one of ``TAILS`` tail classes by their first bytes; within one
they follow the counts of the whole training corpus, (c + 0.1) / (N + 0.1 (V + 1)) over its words. So the distribution is
over all words there are, known or not.

Lanes hold documents one after another. Training steps over windows of ``WINDOW`` tokens and truncates gradients there
(the state goes on to the next window); scoring carries the state through each whole document. Both begin a document with
a zero state after an end token.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

HEAD, TAILS, CLASSES = 4096, 32, 64
EMBED, HIDDEN = 32, 48
WINDOW, TRAIN_LANES, STEPS, RATE = 24, 64, 2000, 4e-3
#: Of the pass over all documents: lanes, windows of all lanes that are held at once, and the rate at first.
PASS_LANES, PASS_WINDOWS, PASS_RATE = 256, 32, 1.5e-3
#: Steps that are scored at once, and documents side by side.
STRIDE, LANES = 64, 256
#: Rows of a softmax that are made at once, so that they stay in the processor's cache.
ROWS = 2048
END = 0


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % TAILS


def classes(counts: np.ndarray) -> np.ndarray:
    """The class of each head token, from counts in descending order."""
    root = np.sqrt(np.maximum(counts, 1))
    edges = np.cumsum(root) - root
    return np.minimum(edges / max(root.sum(), 1) * CLASSES, CLASSES - 1).astype(np.int64)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` turned, in its place and some rows at once, into exp(x - the row's maximum); the maxima and the rows' sums."""
    top, total = np.empty(len(x), np.float32), np.empty(len(x), np.float32)
    for i in range(0, len(x), ROWS):
        rows = x[i : i + ROWS]
        top[i : i + ROWS] = rows.max(1)
        rows -= top[i : i + ROWS, None]
        np.exp(rows, out=rows)
        total[i : i + ROWS] = rows.sum(1)
    return top, total


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at its place ``at``; overwrites ``x``."""
    chosen = x[np.arange(len(x)), at]
    top, total = _exp(x)
    return chosen - top - np.log(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Each row's softmax, in its place."""
    x /= _exp(x)[1][:, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Model:
    """Parameters ``p`` by name; ``of``: each head token's class; tokens from ``len(of)`` on are the tail classes."""

    def __init__(self, p: dict[str, np.ndarray], of: np.ndarray):
        self.p, self.of = p, of
        self.order = np.argsort(of, kind="stable")
        self.bounds = np.searchsorted(of[self.order], np.arange(CLASSES + 1))
        self.within = np.empty(len(of), np.int64)
        self.within[self.order] = np.arange(len(of)) - self.bounds[of[self.order]]
        self.all_of = np.concatenate((of, CLASSES + np.arange(TAILS)))

    @classmethod
    def fresh(cls, counts: np.ndarray, tails: np.ndarray, seed: int = 3) -> Model:
        """Small random weights; the output begins at the unigram distribution."""
        rng, n = np.random.default_rng(seed), len(counts)
        of = classes(counts)
        mass = np.concatenate((np.bincount(of, counts, CLASSES), tails)) + 1.0

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        p = {"emb": rng.standard_normal((n + TAILS, EMBED)).astype(np.float32) * np.float32(0.5), "wx": normal(EMBED, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"wc": np.zeros((HIDDEN, CLASSES + TAILS), np.float32), "bc": np.log(mass / mass.sum()).astype(np.float32), "ww": np.zeros((n, HIDDEN), np.float32), "bw": np.log(counts + 1.0).astype(np.float32)}
        return cls(p, of)

    def flat(self) -> np.ndarray:
        """All weights one after the other."""
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def filled(self, flat: np.ndarray) -> Model:
        """A model of this one's shapes with the weights of ``flat``."""
        parts = np.split(flat, np.cumsum([x.size for x in self.p.values()])[:-1])
        return Model({k: part.reshape(x.shape).copy() for (k, x), part in zip(self.p.items(), parts, strict=True)}, self.of)

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        g = h @ self.p["u"]
        zr = _sigmoid(gates[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, g[:, 2 * HIDDEN :]

    def groups(self, target: np.ndarray):
        """(class, places of its tokens) of the head classes that occur."""
        c = self.all_of[target]
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(edges)):
            yield int(k), order[edges[k] : edges[k + 1]]

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability after state ``h``; of a tail class as a whole."""
        out = _log_softmax_at(h @ self.p["wc"] + self.p["bc"], self.all_of[target]).astype(np.float64)
        for k, at in self.groups(target):
            own = self.order[self.bounds[k] : self.bounds[k + 1]]
            if len(own) > 1:
                out[at] += _log_softmax_at(h[at] @ self.p["ww"][own].T + self.p["bw"][own], self.within[target[at]])
        return out

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """The sum of log probabilities of each document's tokens."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        queue = [(0, i, []) for i in range(min(lanes, len(docs)))]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            load, lane, held = heapq.heappop(queue)
            held.append(i)
            heapq.heappush(queue, (load + len(docs[i]), lane, held))
        queue.sort(key=lambda q: -q[0])
        length = np.array([q[0] for q in queue])
        tokens, of = np.zeros((length[0], len(queue)), np.int32), np.zeros((length[0], len(queue)), np.int32)
        first = np.zeros((length[0], len(queue)), bool)
        for k, (load, _, held) in enumerate(queue):
            if load:
                tokens[:load, k] = np.concatenate([docs[i] for i in held])
                of[:load, k] = np.repeat(held, [len(docs[i]) for i in held])
                first[np.cumsum([0, *[len(docs[i]) for i in held[:-1]]]), k] = True
        gates = self.p["emb"] @ self.p["wx"] + self.p["b"]
        h, last = np.zeros((len(queue), HIDDEN), np.float32), np.zeros(len(queue), np.int32)
        for t in range(0, int(length[0]), STRIDE):
            k = int(np.count_nonzero(length > t))
            n = min(STRIDE, int(length[0]) - t)
            states = np.empty((n, k, HIDDEN), np.float32)
            for j in range(n):
                new = first[t + j, :k]
                before = np.where(new, END, last[:k] if j == 0 else tokens[t + j - 1, :k])
                own = h[:k] * ~new[:, None]
                states[j] = h[:k] = self.step(gates[before], own)[0]
            last = tokens[t + n - 1]
            live = length[:k] > np.arange(t, t + n)[:, None]
            logs = self.log_probs(states[live], tokens[t : t + n, :k][live])
            total += np.bincount(of[t : t + n, :k][live], logs, len(docs))
        return total


class Moments:
    """Adam's moments; ``done`` counts its steps."""

    def __init__(self, model: Model):
        self.m = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.v = {k: np.zeros_like(x) for k, x in model.p.items()}
        self.done = 0


def train_on(model: Model, docs: list[np.ndarray], moments: Moments) -> int:
    """One pass over all tokens of the documents, windows of long ones included; the number of tokens."""
    tokens = sum(map(len, docs))
    lanes = max(1, min(PASS_LANES, tokens // (8 * WINDOW)))
    train(model, docs, -(-tokens // (lanes * WINDOW)), lanes=lanes, moments=moments)
    return tokens


def train(model: Model, docs: list[np.ndarray], steps: int = STEPS, seed: int = 11, lanes: int = TRAIN_LANES, moments: Moments | None = None) -> Model:
    """Truncated backpropagation with Adam over the documents, again and again in seeded orders. Given moments are gone on
    with, at the rate of the pass."""
    docs = [d for d in docs if len(d)]
    if not docs or not steps:
        return model
    rng, p = np.random.default_rng(seed), model.p
    held = moments or Moments(model)
    m, v, begun = held.m, held.v, held.done
    need, parts, firsts, have = WINDOW * steps * lanes, [], [], 0
    while have < need:
        for i in rng.permutation(len(docs)):
            parts.append(docs[i])
            firsts.append(have)
            have += len(docs[i])
            if have >= need:
                break
    stream = np.concatenate(parts)[:need].reshape(lanes, -1).T
    new = np.zeros(need, bool)
    new[[f for f in firsts if f < need]] = True
    new = new.reshape(lanes, -1).T
    new[0] = True
    h = np.zeros((lanes, HIDDEN), np.float32)
    for s in range(steps):
        a = s * WINDOW
        target, fresh = stream[a : a + WINDOW], new[a : a + WINDOW]
        before = np.where(fresh, END, np.concatenate((stream[a - 1 : a] if a else stream[:1] * 0, target[:-1])))
        x = p["emb"][before]
        gates = x @ p["wx"] + p["b"]
        kept, states = [], np.empty((WINDOW, lanes, HIDDEN), np.float32)
        for t in range(WINDOW):
            own = h * ~fresh[t][:, None]
            h, *rest = model.step(gates[t], own)
            kept.append((own, *rest))
            states[t] = h
        flat, goal = states.reshape(-1, HIDDEN), target.reshape(-1)
        scale = np.float32(1 / len(goal))
        grad = {k: np.zeros_like(w) for k, w in p.items() if k in ("ww", "bw", "emb")}
        dc = _softmax(flat @ p["wc"] + p["bc"])
        dc[np.arange(len(goal)), model.all_of[goal]] -= 1
        dc *= scale
        grad["wc"], grad["bc"], dflat = flat.T @ dc, dc.sum(0), dc @ p["wc"].T
        for k, at in model.groups(goal):
            own = model.order[model.bounds[k] : model.bounds[k + 1]]
            if len(own) > 1:
                states_at, weights = flat[at], p["ww"][own]
                dw = _softmax(states_at @ weights.T + p["bw"][own])
                dw[np.arange(len(at)), model.within[goal[at]]] -= 1
                dw *= scale
                grad["ww"][own], grad["bw"][own] = dw.T @ states_at, dw.sum(0)
                dflat[at] += dw @ weights
        # Through time only the state's gradient goes step by step; the weights' are products over the whole window.
        dstates, dgates, dh = dflat.reshape(states.shape), np.empty_like(gates), np.zeros_like(h)
        drec, before_all = np.empty_like(gates), np.empty_like(states)
        for t in range(WINDOW - 1, -1, -1):
            own, z, r, n, gn = kept[t]
            dh += dstates[t]
            dz, dr, da = dgates[t, :, :HIDDEN], dgates[t, :, HIDDEN : 2 * HIDDEN], dgates[t, :, 2 * HIDDEN :]
            np.multiply(dh * (1 - z), 1 - n * n, out=da)
            np.multiply(dh * (own - n), z * (1 - z), out=dz)
            np.multiply(da * gn, r * (1 - r), out=dr)
            drec[t, :, : 2 * HIDDEN] = dgates[t, :, : 2 * HIDDEN]
            np.multiply(da, r, out=drec[t, :, 2 * HIDDEN :])
            before_all[t] = own
            dh *= z
            dh += drec[t] @ p["u"].T
            dh *= ~fresh[t][:, None]
        dg2 = dgates.reshape(-1, 3 * HIDDEN)
        grad["u"] = before_all.reshape(-1, HIDDEN).T @ drec.reshape(-1, 3 * HIDDEN)
        grad["wx"], grad["b"] = x.reshape(-1, EMBED).T @ dg2, dg2.sum(0)
        order = np.argsort(before, axis=None, kind="stable")
        tokens, starts = np.unique(before.reshape(-1)[order], return_index=True)
        grad["emb"][tokens] = np.add.reduceat((dg2 @ p["wx"].T)[order], starts)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        n = begun + s
        rate = PASS_RATE / np.sqrt(1 + n / 64) if moments else RATE * (1 - s / steps) + 1e-5
        rate = np.float32(rate) * np.float32(np.sqrt(1 - 0.99 ** (n + 1)) / (1 - 0.9 ** (n + 1)))
        for k, g in grad.items():
            g = g * clip
            m[k] += np.float32(0.1) * (g - m[k])
            v[k] += np.float32(0.01) * (g * g - v[k])
            p[k] -= rate * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))
    held.done += steps
    return model
