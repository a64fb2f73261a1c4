"""A bidirectional LSTM that labels every element of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time by sequence by feature, and a mask of what is no padding."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(sequences), 1), np.float32)
    for i, s in enumerate(sequences):
        x[: len(s), i], mask[: len(s), i] = s, 1
    return x, mask


class BiLstm:
    """Weights of both directions and of the output: probability that an element is content."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {"out": np.zeros(2 * hidden + 1, np.float32)}
        self.weights["out"][:-1] = draw.normal(0, 0.3, 2 * hidden)
        for way in ("forth", "back"):
            w = draw.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden + 1, 4 * hidden)).astype(np.float32)
            w[-1] = 0
            w[-1, hidden : 2 * hidden] = 1  # remember at first
            self.weights[way] = w

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, w = self.hidden, self.weights[way]
        steps = range(len(x)) if way == "forth" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((len(x), x.shape[1], n), np.float32)
        inner = x @ w[: x.shape[2]] + w[-1]
        for t in steps:
            gates = inner[t] + h @ w[x.shape[2] : -1]
            i, f, o = (_sigmoid(gates[:, k * n : (k + 1) * n]) for k in range(3))
            g = np.tanh(gates[:, 3 * n :])
            new_c = (f * c + i * g) * mask[t]
            squashed = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, squashed))
            h, c = o * squashed * mask[t], new_c
            out[t] = h
        return out

    def probabilities(self, sequences: list[np.ndarray], group: int = 256) -> list[np.ndarray]:
        """Content probability of each element; sequences of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            part = order[at : at + group]
            while len(part) > 1 and len(part) * len(sequences[part[-1]]) > 20_000:
                part = part[: len(part) // 2]
            x, mask = _padded([sequences[i] for i in part])
            both = np.concatenate([self._run(way, x, mask) for way in ("forth", "back")], axis=2)
            p = _sigmoid(both @ self.weights["out"][:-1] + self.weights["out"][-1])
            for column, i in enumerate(part):
                out[i] = p[: len(sequences[i]), column]
            at += len(part)
        return out

    def _gradient(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, known: np.ndarray) -> dict:
        n, grads, kept, outs = self.hidden, {}, {}, {}
        for way in ("forth", "back"):
            kept[way] = []
            outs[way] = self._run(way, x, mask, kept[way])
        both = np.concatenate([outs["forth"], outs["back"]], axis=2)
        p = _sigmoid(both @ self.weights["out"][:-1] + self.weights["out"][-1])
        d = (p - target) * known / max(1.0, known.sum())
        grads["out"] = np.append(np.einsum("tb,tbh->h", d, both), d.sum()).astype(np.float32)
        for k, way in enumerate(("forth", "back")):
            w = self.weights[way]
            dw = np.zeros_like(w)
            dh = np.zeros((x.shape[1], n), np.float32)
            dc = np.zeros_like(dh)
            up = d[..., None] * self.weights["out"][k * n : (k + 1) * n]
            for t, h, c, i, f, o, g, squashed in reversed(kept[way]):
                dh = (dh + up[t]) * mask[t]
                dc = (dc + dh * o * (1 - squashed**2)) * mask[t]
                gates = np.concatenate(
                    [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1
                )
                dw[: x.shape[2]] += x[t].T @ gates
                dw[x.shape[2] : -1] += h.T @ gates
                dw[-1] += gates.sum(axis=0)
                dh, dc = gates @ w[x.shape[2] : -1].T, dc * f
            grads[way] = dw
        return grads

    def fit(
        self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, group: int = 24, rate: float = 0.01,
        seed: int = 3,
    ) -> BiLstm:
        """Adam on the cross-entropy of labels 0 and 1; elements labelled -1 are context only."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        groups = [order[a : a + group] for a in range(0, len(order), group)]
        for _ in range(rounds):
            for number in draw.permutation(len(groups)):
                part = groups[number]
                x, mask = _padded([sequences[i] for i in part])
                y, _ = _padded([labels[i][:, None].astype(np.float32) for i in part])
                y = y[..., 0]
                grads = self._gradient(x, mask, np.maximum(y, 0), (y >= 0) * mask[..., 0])
                step += 1
                for k, grad in grads.items():
                    grad = np.clip(grad, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = (self.weights[k] - rate * move).astype(np.float32)
        return self
