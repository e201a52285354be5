"""Gradient-boosted trees for two classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 60
    depth: int = 4
    bins: int = 32
    rate: float = 0.2
    leaf_weight: float = 1.0  # least sum of second derivatives in a leaf
    shrink: float = 1.0


@dataclass(frozen=True)
class Trees:
    """Complete trees: node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, config: BoostConfig = BoostConfig()) -> Trees:
    """Trees for labels 0 and 1, by histograms of first and second derivatives of the logistic loss."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, config.bins + 1)[1:-1], method="lower")) for f in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = config.bins
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(n, base)
    inner = 2**config.depth - 1
    features, borders, leaves = [], [], []
    flat = binned + width * np.arange(m)
    for _ in range(config.trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = chance - y, np.maximum(chance * (1 - chance), 1e-6)
        feature, border, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(config.depth):
            first = 2**level - 1
            keys = ((node - first)[:, None] * (m * width) + flat).ravel()
            shape = (2**level, m, width)
            g = np.bincount(keys, np.repeat(slope, m), int(np.prod(shape))).reshape(shape)
            h = np.bincount(keys, np.repeat(bend, m), int(np.prod(shape))).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + config.shrink) + (gt - gl) ** 2 / (ht - hl + config.shrink) - gt**2 / (ht + config.shrink)
            gain[(hl < config.leaf_weight) | (ht - hl < config.leaf_weight)] = -1
            for k in range(2**level):
                f, b = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], border[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > border[node])
        at = node - inner
        g, h = np.bincount(at, slope, inner + 1), np.bincount(at, bend, inner + 1)
        leaf = -config.rate * g / (h + config.shrink)
        score += leaf[at]
        features.append(feature)
        borders.append(border)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(borders), np.array(leaves), base)
