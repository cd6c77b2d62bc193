"""Isolation forests of many series at once, in numpy.

All features are one-sided (large is unusual), so a value above every sampled one
of a node leads into an empty branch: it is isolated at once.
"""

from __future__ import annotations

import numpy as np

TREES, SAMPLE, DEPTH = 16, 64, 6


def mix(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, 2 * (np.log(m - 1 + (m == 2) * 1e-12) * (m > 2) + 0.5772156649 * (m > 2)) - 2 * (m - 1) / m * (m > 2) + (n == 2))


class Forests:
    """Trees of several series. feature, threshold: [series, tree, inner node]; path: [series, tree, leaf]."""

    def __init__(self, ids: np.ndarray, pool: np.ndarray, offset: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH) -> None:
        """pool: the sampled feature rows of all series, those of series s at offset[s]:offset[s + 1] (at least one each)."""
        s, f = len(ids), pool.shape[1]
        self.trees, self.depth, self.sample = trees, depth, sample
        inner, tree = 2**depth - 1, np.arange(s * trees, dtype=np.int64)
        seed = mix(np.repeat(ids.astype(np.int64), trees).astype(np.uint64) * np.uint64(1_000_003) + np.tile(np.arange(trees, dtype=np.uint64), s))
        n = np.repeat(np.diff(offset), trees)
        pick = _uniform(seed[:, None] + np.arange(sample, dtype=np.uint64)[None, :])
        rows = (np.repeat(offset[:-1], trees)[:, None] + (pick * n[:, None]).astype(np.int64)).ravel()
        of = np.repeat(tree, sample)
        node = np.zeros(len(rows), np.int64)
        self.feature = np.zeros((s * trees, inner), np.int64)
        self.threshold = np.full((s * trees, inner), np.inf, np.float32)
        steps = np.full((s * trees, 2 * inner + 1), np.nan, np.float32)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            at = of * width + (node - first)
            k = s * trees * width
            key = seed[:, None] + np.uint64(7919) * (np.arange(first, first + width, dtype=np.uint64)[None, :] + np.uint64(sample))
            feat = (_uniform(key) * f).astype(np.int64).ravel()
            x = pool[rows, feat[at]]
            low, high = np.full(k, np.inf, np.float32), np.full(k, -np.inf, np.float32)
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
            count = np.bincount(at, minlength=k)
            low[count == 0] = high[count == 0] = 0
            cut = low + _uniform(key + np.uint64(1)).ravel().astype(np.float32) * (high - low)
            ended = count <= 1
            own = np.where(count <= 1, d, np.nan).astype(np.float32).reshape(s * trees, width)
            above = steps[:, (np.arange(first, first + width) - 1) // 2] if d else np.full((s * trees, 1), np.nan, np.float32)
            steps[:, first:first + width] = np.where(np.isnan(above), own, above)  # a leaf's length holds below it
            self.feature[:, first:first + width] = feat.reshape(s * trees, width)
            self.threshold[:, first:first + width] = np.where(ended, np.inf, cut).reshape(s * trees, width)
            node = 2 * node + 1 + (x > self.threshold[of, node])
        count = np.bincount(of * (inner + 1) + (node - inner), minlength=s * trees * (inner + 1)).reshape(s * trees, inner + 1)
        above = steps[:, (np.arange(inner, 2 * inner + 1) - 1) // 2]
        self.path = np.where(np.isnan(above), depth + mean_path(count), above).astype(np.float32)

    def score(self, series: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each row of x, which belongs to series[i] (a position in ids): 0 usual, 1 unusual."""
        total = np.zeros(len(x), np.float32)
        inner = 2**self.depth - 1
        feature, threshold, path, flat = self.feature.ravel(), self.threshold.ravel(), self.path.ravel(), np.ascontiguousarray(x).ravel()
        row = np.arange(len(x)) * x.shape[1]
        for t in range(self.trees):
            base = (series * self.trees + t) * inner
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = base + node
                node = 2 * node + 1 + (flat[row + feature[at]] > threshold[at])
            total += path[(series * self.trees + t) * (inner + 1) + node - inner]
        return np.exp2(-(total / self.trees) / float(mean_path(np.array(self.sample))))

    def least_score(self, feature: int, floor: float) -> np.ndarray:
        """By series, a bound that the score of no row falls below whose `feature` is at least `floor`, whatever its others are: that of the
        longest paths which the trees have for such rows, less what rounding may do."""
        longest = self.path
        for d in reversed(range(self.depth)):
            at = slice(2**d - 1, 2 ** (d + 1) - 1)
            left, right = longest[:, 0::2], longest[:, 1::2]
            longest = np.where((self.feature[:, at] == feature) & (self.threshold[:, at] < floor), right, np.maximum(left, right))
        total = longest.reshape(-1, self.trees).sum(axis=1, dtype=np.float64)
        return np.exp2(-(total / self.trees) / float(mean_path(np.array(self.sample)))) * (1 - 1e-5)
