"""A bidirectional LSTM over characters with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters: `embed` (2, symbols, 4H) gate inputs per symbol and direction, `recur` (2, H, 4H),
    `out` (2H, tags), `bias` (tags), `move` (tags, tags) transitions, `start` (tags)."""

    def __init__(self, symbols: int, tags: int, hidden: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        self.p = {
            "embed": draw.normal(0, 0.3, (2, symbols, 4 * hidden)),
            "recur": draw.normal(0, hidden ** -0.5, (2, hidden, 4 * hidden)),
            "out": draw.normal(0, hidden ** -0.5, (2 * hidden, tags)),
            "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "start": np.zeros(tags)}
        self.p["embed"][:, :, hidden:2 * hidden] += 0.5  # forget gates start open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, T, B, H) of both directions, each in its own reading order."""
        size, steps, h = self.hidden, x.shape[1], self.hidden
        both = np.stack([x.T, x.T[::-1]])
        inputs = np.stack([self.p["embed"][d][both[d]] for d in (0, 1)])
        state = np.zeros((2, len(x), size), self.p["recur"].dtype)
        cell = np.zeros_like(state)
        out = np.empty((2, steps, len(x), size), state.dtype)
        for t in range(steps):
            z = inputs[:, t] + state @ self.p["recur"]
            gates = _sigmoid(z[..., :3 * h])
            i, f, o = gates[..., :h], gates[..., h:2 * h], gates[..., 2 * h:]
            g = np.tanh(z[..., 3 * h:])
            before, last = cell, state
            cell = f * cell + i * g
            bent = np.tanh(cell)
            state = o * bent
            out[:, t] = state
            if keep is not None:
                keep.append((i, f, o, g, before, bent, last))
        return out

    def emissions(self, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(B, T, tags) scores of symbol sequences (B, T), and the hidden states they come from."""
        out = self._run(x, keep)
        states = np.concatenate([out[0], out[1, ::-1]], axis=-1).transpose(1, 0, 2)
        return states @ self.p["out"] + self.p["bias"], states

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence (B, T) under the CRF."""
        scores, _ = self.emissions(x)
        steps = x.shape[1]
        best = scores[:, 0] + self.p["start"]
        back = np.empty((steps, len(x), self.tags), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"]
            back[t] = paths.argmax(1)
            best = paths.max(1) + scores[:, t]
        tags = np.empty(x.shape, np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(x))
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        return tags

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (B, T), and its gradients."""
        keep: list = []
        e, states = self.emissions(x, keep)
        n, steps, tags = e.shape
        move, start, h = self.p["move"], self.p["start"], self.hidden
        ahead = np.empty_like(e)
        ahead[:, 0] = e[:, 0] + start
        for t in range(1, steps):
            ahead[:, t] = _logsumexp(ahead[:, t - 1][:, :, None] + move, 1) + e[:, t]
        total = _logsumexp(ahead[:, -1], 1)
        behind = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            behind[:, t] = _logsumexp(move + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        single = np.exp(ahead + behind - total[:, None, None])
        pair = np.zeros_like(move)
        for t in range(1, steps):
            pair += np.exp(ahead[:, t - 1][:, :, None] + move + (e[:, t] + behind[:, t])[:, None, :]
                           - total[:, None, None]).sum(0)
        rows = np.arange(n)
        gold = (e[rows[:, None], np.arange(steps), y].sum() + start[y[:, 0]].sum()
                + move[y[:, :-1], y[:, 1:]].sum())
        single[rows[:, None], np.arange(steps), y] -= 1
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d = single / n
        grad = {"move": pair / n, "start": d[:, 0].sum(0), "bias": d.sum((0, 1)),
                "out": np.tensordot(states, d, ((0, 1), (0, 1)))}
        dstates = (d @ self.p["out"].T).transpose(1, 0, 2)
        dout = np.stack([dstates[..., :h], dstates[::-1, :, h:]])
        both = np.stack([x.T, x.T[::-1]])
        grad["embed"], grad["recur"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["recur"])
        dh, dc = np.zeros_like(keep[0][0]), np.zeros_like(keep[0][0])
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, bent, last = keep[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - bent * bent)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f),
                                 dh * bent * o * (1 - o), dc * i * (1 - g * g)], axis=-1)
            grad["recur"] += last.transpose(0, 2, 1) @ dz
            for k in (0, 1):
                np.add.at(grad["embed"][k], both[k, t], dz[k])
            dh = dz @ self.p["recur"].transpose(0, 2, 1)
            dc = dc * f
        return float((total.sum() - gold) / n), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float = 0.02,
            seed: int = 3) -> list[float]:
        """Adam over random batches; the same rows and seed give the same parameters."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(x), min(batch, len(x)))
            value, grad = self.loss(x[pick], y[pick])
            losses.append(value)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                ahead = first[k] / (1 - 0.9 ** step)
                self.p[k] -= (speed * ahead / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                              ).astype(self.p[k].dtype)
        return losses
