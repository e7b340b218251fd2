"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Trees of one depth for a binary label; scores are probabilities.

    Nodes of all trees lie in arrays of one row a tree; a node's children stand side by side at
    ``left`` and ``left + 1``. A leaf is its own child on both sides, so all rows and trees descend
    together, ``depth`` times, without a branch.
    """

    def __init__(self, base: float, depth: int, feature, limit, left, value):
        self.base, self.depth = base, depth
        self.feature, self.limit, self.left, self.value = feature, limit, left, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            leaf = self.left[tree, node] == node
            down = x[row, self.feature[tree, node]] > self.limit[tree, node]
            node = self.left[tree, node] + (down & ~leaf)
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=1))))


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature, at quantiles of its distinct values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.12, ridge: float = 2.0,
    least_rows: int = 20, bins: int = BINS,
) -> Boosted:
    """Newton boosting of the log loss; splits are sought in histograms of binned features."""
    rows, width = x.shape
    mean = (y.sum() + 1) / (rows + 2)
    base = float(np.log(mean / (1 - mean)))
    cuts = edges(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1) if rows else np.zeros((0, width), int)
    size = 2 ** (depth + 1) - 1
    shape = (trees, size)
    feature, left = np.zeros(shape, np.int64), np.tile(np.arange(size), (trees, 1))
    limit, value = np.zeros(shape), np.zeros(shape)
    offset = np.arange(width) * bins
    margin = np.full(rows, base)
    for t in range(trees if rows else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node, used = np.zeros(rows, np.int64), 1
        open_nodes = [0]
        for _ in range(depth):
            place = np.full(size, -1)
            place[open_nodes] = np.arange(len(open_nodes))
            live = np.flatnonzero(place[node] >= 0)
            cell = (place[node[live]][:, None] * width * bins + offset + binned[live]).ravel()
            total = len(open_nodes) * width * bins
            box = lambda w: np.bincount(cell, w, total).reshape(len(open_nodes), width, bins)
            g, h, n = (np.cumsum(box(np.repeat(w[live], width)), axis=2) for w in (grad, hess, np.ones(rows)))
            all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(n < least_rows) | (all_n - n < least_rows)] = 0
            split = []
            for i, at in enumerate(open_nodes):
                f, b = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, at], limit[t, at], left[t, at] = f, cuts[f][b], used
                    mine = np.flatnonzero(node == at)
                    node[mine] = used + (binned[mine, f] > b)
                    split += [used, used + 1]
                    used += 2
            open_nodes = split
            if not split:
                break
        g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
        value[t] = rate * g / (h + ridge)
        margin += value[t][node]
    return Boosted(base, depth, feature, limit, left, value)
