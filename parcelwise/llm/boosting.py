"""Gradient-boosted trees for two classes, on binned columns in numpy.

All trees of one model are complete and of one depth, so that a batch descends them with array lookups alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """``column`` and ``cut`` of every inner node and ``leaf`` values, one row a tree; ``borders`` bin the columns."""

    borders: list[np.ndarray]
    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, rows[:, j], side="left") for j, b in enumerate(self.borders)], axis=1).astype(np.uint8)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for every row."""
        bins = self.binned(rows)
        total = np.full(len(rows), self.start)
        for column, cut, leaf in zip(self.column, self.cut, self.leaf):
            total += leaf[_descend(bins, column, cut, len(leaf).bit_length() - 1)]
        return total


def _descend(bins: np.ndarray, column: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf every row comes to."""
    each, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (bins[each, column[node]] > cut[node])
    return node - len(column)


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 4.0, share: float = 0.5, seed: int = 0) -> Trees:
    """Newton boosting of the logistic loss; every tree sees a ``share`` of the rows, ``least`` is the least curvature on either side of a cut."""
    rng = np.random.default_rng(seed)
    borders = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(rows.shape[1])]
    prior = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    model = Trees(borders, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.uint8), np.zeros((0, 2**depth)), float(np.log(prior / (1 - prior))))
    every, total = np.asfortranarray(model.binned(rows)), np.full(len(rows), model.start)
    columns, cuts, leaves = [], [], []
    for _ in range(trees):
        drawn = np.flatnonzero(rng.random(len(rows)) < share)
        bins = np.asfortranarray(every[drawn], np.int64)
        chance = 1 / (1 + np.exp(-total[drawn]))
        slope, bend = labels[drawn] - chance, chance * (1 - chance)
        column, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.uint8)
        node = np.zeros(len(drawn), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j in range(rows.shape[1]):
                place = (node - first) * BINS + bins[:, j]
                g, h = (np.bincount(place, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (slope, bend))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain[(h < least) | (h_all - h < least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best = np.where(better, gain[np.arange(width), top], best)
                column[first : first + width][better] = j
                cut[first : first + width][better] = top[better]
            node = 2 * node + 1 + (bins[np.arange(len(drawn)), column[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, slope, 2**depth) / (np.bincount(at, bend, 2**depth) + ridge)
        total += leaf[_descend(every, column, cut, depth)]
        columns.append(column)
        cuts.append(cut)
        leaves.append(leaf)
    model.column, model.cut, model.leaf = np.array(columns), np.array(cuts), np.array(leaves)
    return model
