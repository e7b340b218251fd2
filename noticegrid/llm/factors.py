"""A factorization machine over binary features, in numpy."""

from __future__ import annotations

import numpy as np


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the inner products of their factors)."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of rows given as ragged feature numbers."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(row, self.weights[index], len(sizes))
        total, squares = _sums(self.factors[index], row, sizes)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)

    def scores(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(index, sizes), -35, 35)))


def _sums(v: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total, squares = np.zeros((len(sizes), v.shape[1])), np.zeros((len(sizes), v.shape[1]))
    filled = np.flatnonzero(sizes)
    if len(filled):
        start = (np.cumsum(sizes) - sizes)[filled]
        total[filled] = np.add.reduceat(v, start, axis=0)
        squares[filled] = np.add.reduceat(v**2, start, axis=0)
    return total, squares


def fit(
    index: np.ndarray, sizes: np.ndarray, y: np.ndarray, width: int, *, rank: int = 8, epochs: int = 12, batch: int = 256,
    rate: float = 0.02, decay: float = 2e-3, seed: int = 11,
) -> Machine:
    """Adam on the log loss with decay of weights and factors."""
    rng = np.random.default_rng(seed)
    mean = (y.sum() + 1) / (len(y) + 2)
    params = [np.array([np.log(mean / (1 - mean))]), np.zeros(width), rng.normal(0, 0.05, (width, rank))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    starts, step = np.cumsum(sizes) - sizes, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            n = sizes[rows]
            features = index[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            model = Machine(params[0][0], params[1], params[2])
            wrong = (model.scores(features, n) - y[rows]) / len(rows)
            row = np.repeat(np.arange(len(rows)), n)
            v = params[2][features]
            total, _ = _sums(v, row, n)
            used, place = np.unique(features, return_inverse=True)
            g_w = np.bincount(place, wrong[row], len(used))
            inner = wrong[row][:, None] * (total[row] - v)
            g_v = np.stack([np.bincount(place, inner[:, f], len(used)) for f in range(rank)], axis=1) if len(used) else np.zeros((0, rank))
            step += 1
            grads = [(slice(None), np.array([wrong.sum()])), (used, g_w + decay * params[1][used] / 10), (used, g_v + decay * params[2][used])]
            for p, (m, s), (where, g) in zip(params, moments, grads):
                m[where] = 0.9 * m[where] + 0.1 * g
                s[where] = 0.99 * s[where] + 0.01 * g**2
                lift = (1 - 0.9**step) / np.sqrt(1 - 0.99**step)
                p[where] -= rate * m[where] / lift / (np.sqrt(s[where]) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])
