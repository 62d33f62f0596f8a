"""Histogram gradient-boosted trees with logistic loss, trained on a bounded sample, flattened for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in flat arrays; node k of a tree has children 2k+1 and 2k+2, a leaf points to itself."""

    feature: np.ndarray  # (trees, nodes) int16
    threshold: np.ndarray  # (trees, nodes) float64: go right if value > threshold
    value: np.ndarray  # (trees, nodes) float64, of the leaves reached
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of x, all rows walking a tree level by level."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting over feature histograms. One class only: a constant score near its label; no rows: 0.5."""
    nodes = 2 ** (depth + 1) - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(np.zeros((0, nodes), np.int16), np.zeros((0, nodes)), np.zeros((0, nodes)), float(np.log(share / (1 - share))), depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width, n_features = bins, x.shape[1]
    flat = binned + np.arange(n_features) * width
    score = np.full(len(y), model.base)
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(nodes, np.int16), np.full(nodes, np.inf), np.zeros(nodes)
        members = {0: np.arange(len(y))}
        for k in range(nodes):
            rows = members.pop(k, None)
            if rows is None:
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            cut, best = None, 1e-9
            if 2 * k + 2 < nodes:
                cells = flat[rows].ravel()
                size = n_features * width
                hg = np.bincount(cells, np.repeat(g[rows], n_features), size).reshape(n_features, width).cumsum(axis=1)
                hh = np.bincount(cells, np.repeat(h[rows], n_features), size).reshape(n_features, width).cumsum(axis=1)
                right = total_h - hh
                gain = hg**2 / (hh + l2) + (total_g - hg) ** 2 / (right + l2) - total_g**2 / (total_h + l2)
                gain[(hh < least) | (right < least)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > best and b < len(edges[f]):
                    cut = int(f), int(b)
            if cut:
                feature[k], threshold[k] = cut[0], edges[cut[0]][cut[1]]
                goes = binned[rows, cut[0]] > cut[1]
                members[2 * k + 1], members[2 * k + 2] = rows[~goes], rows[goes]
            else:
                step = -rate * total_g / (total_h + l2)
                score[rows] += step
                # a leaf above the last level hands its value down the left side, where infinite thresholds lead
                while 2 * k + 1 < nodes:
                    k = 2 * k + 1
                value[k] = step
        kept.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(a) for a in zip(*kept, strict=True))
    return model
