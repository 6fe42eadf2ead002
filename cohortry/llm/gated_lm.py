"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

import numpy as np

END, RARE = 0, 1


def _with_one(states: np.ndarray) -> np.ndarray:
    """Rows with a 1 behind them, which biases are multiplied by."""
    out = np.ones((len(states), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states
    return out


def _exp_sums(x: np.ndarray) -> np.ndarray:
    """Row sums of exp(x). x becomes exp(x); logits count as 80 at most, which keeps every sum finite."""
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


class GatedLM:
    """Predicts numbers below len(counts) from those before, by their class and then within it.

    counts: how often each number was seen, most frequent first for short classes of frequent ones: classes have about
    equal shares of the roots of the counts. The first biases are the logs of the counts' shares.
    """

    def __init__(self, counts: np.ndarray, hidden: int = 16, classes: int | None = None, seed: int = 0):
        rng, known = np.random.default_rng(seed), len(counts)
        self.hidden, counts = hidden, np.asarray(counts, np.float64) + 1
        share = np.cumsum(np.sqrt(counts))
        cut = (share / share[-1] * (classes or max(1, int(known**0.5) // 2)) * (1 - 1e-9)).astype(np.int64)
        self.first = np.r_[np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]), known]
        self.group = np.repeat(np.arange(len(self.first) - 1, dtype=np.int16), np.diff(self.first))
        mass = np.add.reduceat(counts, self.first[:-1])
        f = np.float32
        self.weights = {
            "input": rng.normal(0, 0.1, (known, 3 * hidden)).astype(f),
            "state": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(f),
            "bias": np.zeros(3 * hidden, f),
            "class": np.vstack([np.zeros((hidden, len(mass))), np.log(mass / mass.sum())]).astype(f),  # the last row and column are biases
            "word": np.hstack([np.zeros((known, hidden)), np.log(counts / mass[self.group])[:, None]]).astype(f),
        }

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.weights.values()]).astype("<f4").tobytes()

    def load(self, data: bytes) -> GatedLM:
        flat, at = np.frombuffer(data, "<f4"), 0
        for name, x in self.weights.items():
            self.weights[name] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size
        return self

    def states(self, before: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of T steps of B lanes; a document starts after an END, from the zero state.

        Within, lanes are the last axis, so that each gate is one stretch of memory. keep gets the states before each
        step, the gates, the candidates and what the reset gate weighs.
        """
        n, w = self.hidden, self.weights
        inputs = np.ascontiguousarray((w["input"] + w["bias"])[before].transpose(0, 2, 1))
        goes_on = (before != END).astype(inputs.dtype)[:, None, :]
        shape = len(before), n, before.shape[1]
        out, from_state = np.empty(shape, inputs.dtype), np.empty(inputs.shape, inputs.dtype)
        old, more, h, across = np.empty_like(out), np.empty_like(out[0]), h.T, np.ascontiguousarray(w["state"].T)
        for t in range(len(before)):
            np.multiply(h, goes_on[t], out=old[t])
            u, gates, c = from_state[t], inputs[t, : 2 * n], inputs[t, 2 * n :]
            np.matmul(across, old[t], out=u)
            gates += u[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5  # the logistic function
            np.multiply(gates[:n], u[2 * n :], out=more)
            c += more
            np.tanh(c, out=c)
            h = out[t]
            np.subtract(old[t], c, out=h)
            h *= gates[n:]
            h += c
        if keep is not None:
            keep += [old, inputs[:, :n], inputs[:, n : 2 * n], inputs[:, 2 * n :], from_state[:, 2 * n :]]
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def _by_class(self, group: np.ndarray):
        """(numbers of a class, its rows) for the classes of rows, in order."""
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(len(self.first)))
        for c in np.flatnonzero(np.diff(edges)):
            yield slice(self.first[c], self.first[c + 1]), order[edges[c] : edges[c + 1]]

    def log_probabilities(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of target numbers, one per row of states."""
        w, group, states = self.weights, self.group[target], _with_one(states)
        x = states @ w["class"]
        out = np.minimum(x[np.arange(len(x)), group].astype(np.float64), 80)
        sums = _exp_sums(x)
        for own, rows in self._by_class(group):
            if own.stop - own.start > 1:  # a class of one number needs no choice
                x = states[rows] @ w["word"][own].T
                out[rows] += np.minimum(x[np.arange(len(x)), target[rows] - own.start], 80)
                sums[rows] *= _exp_sums(x)
        return out - np.log(sums)

    def learn(self, before: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray, memory: dict, rate: float) -> np.ndarray:
        """One window of truncated backpropagation with Adagrad steps; returns the state to go on from."""
        w, n, kept = self.weights, self.hidden, []
        states = self.states(before, h, kept)
        last = states[-1].copy()
        rows = np.flatnonzero(live.ravel())
        flat, goal = _with_one(states.reshape(-1, n)[rows]), target.ravel()[rows]
        group, scale = self.group[goal], np.float32(1 / max(1, len(rows)))
        grad = {}
        x = flat @ w["class"]
        x *= (scale / _exp_sums(x))[:, None]
        x[np.arange(len(goal)), group] -= scale
        grad["class"] = flat.T @ x
        up = x @ w["class"][:n].T
        for own, mine in self._by_class(group):
            if own.stop - own.start > 1:
                h_mine, v = flat[mine], w["word"][own]
                x = h_mine @ v.T
                x *= (scale / _exp_sums(x))[:, None]
                x[np.arange(len(mine)), goal[mine] - own.start] -= scale
                up[mine] += x @ v[:, :n]
                self._step("word", own, x.T @ h_mine, memory, rate)
        d_out = np.zeros((before.size, n), states.dtype)
        d_out[rows] = up
        d_out = np.ascontiguousarray(d_out.reshape(*before.shape, n).transpose(0, 2, 1))
        old, r, z, c, weighed = kept
        to_c, to_z, to_r = (1 - z) * (1 - c * c), (old - c) * (z - z * z), weighed * (r - r * r)
        goes_on = (before != END).astype(states.dtype)[:, None, :]
        d_in, d_u = (np.empty((len(before), 3 * n, before.shape[1]), states.dtype) for _ in range(2))
        d_h = np.zeros_like(d_out[0])
        for t in range(len(before) - 1, -1, -1):
            d_h += d_out[t]
            d_c = d_in[t, 2 * n :]
            np.multiply(d_h, to_c[t], out=d_c)
            np.multiply(d_h, to_z[t], out=d_in[t, n : 2 * n])
            np.multiply(d_c, to_r[t], out=d_in[t, :n])
            d_u[t, : 2 * n] = d_in[t, : 2 * n]
            np.multiply(d_c, r[t], out=d_u[t, 2 * n :])
            d_h *= z[t]
            d_h += w["state"] @ d_u[t]
            d_h *= goes_on[t]
        flat_in = d_in.transpose(0, 2, 1).reshape(-1, 3 * n)
        grad["state"] = old.transpose(1, 0, 2).reshape(n, -1) @ d_u.transpose(0, 2, 1).reshape(-1, 3 * n)
        grad["bias"] = flat_in.sum(axis=0)
        for name, g in grad.items():
            self._step(name, slice(None), np.clip(g, -1, 1), memory, rate)
        numbers = before.ravel()
        order = np.argsort(numbers.astype(np.uint16), kind="stable")
        in_order = numbers[order]
        first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
        self._step("input", in_order[first], np.clip(np.add.reduceat(flat_in[order], first, axis=0), -1, 1), memory, rate)
        return last

    def _step(self, name: str, at, g: np.ndarray, memory: dict, rate: float) -> None:
        past = memory.setdefault(name, np.full_like(self.weights[name], 1e-6))
        past[at] += g * g
        self.weights[name][at] -= np.float32(rate) * g / np.sqrt(past[at])


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[list[list[int]], list[int]]:
    """Documents dealt to lanes of about equal length, longest first; and the lanes' lengths, falling."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    sizes = {k: s for s, k in heap}
    by = sorted(sizes, key=lambda k: -sizes[k])
    return [dealt[k] for k in by], [sizes[k] for k in by]


def windows(docs: list[np.ndarray], lanes: int, window: int):
    """(before, target, owner, live) of each window: T x B arrays; lanes that have ended are left out.

    What follows a document in its lane starts anew, behind an END.
    """
    dealt, sizes = lanes_of(docs, lanes)
    order = [d for lane in dealt for d in lane]
    if not order:
        return
    stream = np.concatenate([docs[d] for d in order])
    owner = np.repeat(np.array(order, np.int64), [len(docs[d]) for d in order])
    before = np.r_[np.int32(END), stream[:-1]]
    before[np.cumsum([0] + [len(docs[d]) for d in order[:-1]])] = END
    sizes = np.array(sizes, np.int64)
    begin = np.cumsum(sizes) - sizes
    for start in range(0, int(sizes.max(initial=0)), window):
        open_ = int((sizes > start).sum())
        steps = np.arange(start, min(start + window, int(sizes[0])))[:, None]
        live = steps < sizes[None, :open_]
        at = np.where(live, begin[None, :open_] + steps, 0)
        yield np.where(live, before[at], END), np.where(live, stream[at], END), owner[at], live


def score_documents(model: GatedLM, docs: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
    """Natural-log probability of each document (numbers, the last one END). State is carried from window to window."""
    out = np.zeros(len(docs))
    h = np.zeros((min(lanes, len(docs)), model.hidden), np.float32)
    for before, target, owner, live in windows(docs, lanes, window):
        states = model.states(before, h[: before.shape[1]])
        h = states[-1]
        rows = np.flatnonzero(live.ravel())
        got = model.log_probabilities(states.reshape(-1, model.hidden)[rows], target.ravel()[rows])
        out += np.bincount(owner.ravel()[rows], got, minlength=len(docs))
    return out


def train_documents(model: GatedLM, docs: list[np.ndarray], memory: dict, lanes: int = 512, window: int = 32, rate: float = 0.1, section: int = 1024) -> None:
    """Learns every word of docs once. Long documents are learned in sections that each start from the zero state, so that lanes end together."""
    docs = [d[at : at + section] for d in docs for at in range(0, len(d), section)]
    h = np.zeros((min(lanes, len(docs)), model.hidden), np.float32)
    for before, target, _, live in windows(docs, lanes, window):
        h = model.learn(before, target, live, h[: before.shape[1]], memory, rate)
