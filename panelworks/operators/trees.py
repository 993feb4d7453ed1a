"""Regression trees of many training sets at once, grown level by level from sums by bin.

Training sets that share their rows (expanding folds of many dates) share the rows' bins too. A level of one tree of every set is one pass: the counts and sums of all
entries by (set, node, bin), from which every node's best split follows. Forests and boosting are loops over such trees. Small helpers of ``alpha.stacked_trees``, which
deals series and dates to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of numbers, element by element: what stands in for random draws."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (np.asarray(p, np.int64).astype(np.uint64) ^ out) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column the distinct inner quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by column (d, rows): values up to the first edge are in bin 0."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int32)


@dataclass(frozen=True)
class Sets:
    """Training sets and their test rows, as entries side by side: the set and the row of each."""

    n: int
    fit: np.ndarray
    row: np.ndarray
    test_fit: np.ndarray
    test_row: np.ndarray

    @classmethod
    def of(cls, train: Sequence[tuple[int, int]], test: Sequence[tuple[int, int]]) -> Sets:
        """From ranges of rows."""

        def entries(ranges):
            lo, size = np.array([a for a, _ in ranges], np.int64), np.array([b - a for a, b in ranges], np.int64)
            fit = np.repeat(np.arange(len(ranges)), size)
            return fit, lo[fit] + np.arange(len(fit)) - np.repeat(np.cumsum(size) - size, size)

        return cls(len(train), *entries(train), *entries(test))


class Table:
    """The bins of all entries, the training ones first, column by column."""

    def __init__(self, bins: np.ndarray, sets: Sets, n_bins: int):
        self.sets, self.n_bins, self.trained = sets, n_bins, len(sets.fit)
        self.fit = np.concatenate([sets.fit, sets.test_fit])
        rows = np.concatenate([sets.row, sets.test_row])
        self.columns = [b[rows].astype(np.int64) for b in bins]
        self.flat, self.place = np.concatenate(self.columns), np.arange(len(rows))


def grow(table: Table, target: np.ndarray, weight: np.ndarray | None, depth: int) -> np.ndarray:
    """One tree for each set: its prediction for all entries of the table. ``target`` and ``weight`` are those of the training entries.

    A split takes what most lowers the squared error, of equal ones the first column and bin; a node without a useful one stays whole.
    """
    sets, n_bins, m = table.sets, table.n_bins, table.trained
    wy = target if weight is None else weight * target
    cell, cells = table.fit, sets.n
    for level in range(depth):
        cells = sets.n << level
        best, column, split = np.full(cells, 1e-15), np.zeros(cells, np.int64), np.full(cells, n_bins, np.int64)
        base = cell[:m] * n_bins
        for j, b in enumerate(table.columns):
            key = base + b[:m]
            left_n = np.bincount(key, weight, cells * n_bins).reshape(cells, n_bins).cumsum(1)
            left_s = np.bincount(key, wy, cells * n_bins).reshape(cells, n_bins).cumsum(1)
            n, s = left_n[:, -1], left_s[:, -1]
            right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
            score = left_s * left_s / np.maximum(left_n, 0.5) + right_s * right_s / np.maximum(right_n, 0.5)
            score[(left_n < 0.5) | (right_n < 0.5)] = -1.0
            k = score.argmax(1)
            top = score[np.arange(cells), k] - s * s / np.maximum(n, 0.5)
            better = top > best * (1 + 1e-9)  # sums in another order are no other gain
            best, column, split = np.where(better, top, best), np.where(better, j, column), np.where(better, k, split)
        value = table.flat[(column * len(table.place))[cell] + table.place]
        cell = 2 * cell + (value > split[cell])
    leaves = sets.n << depth
    n, s = np.bincount(cell[:m], weight, leaves), np.bincount(cell[:m], wy, leaves)
    return np.divide(s, n, out=np.zeros(leaves), where=n > 0)[cell]


def forest(table: Table, y: np.ndarray, trees: int, depth: int, seed: int = 0) -> np.ndarray:
    """Mean prediction for the test entries of trees on samples, drawn by a hash of tree, set's rows and draw; ``y`` by row."""
    sets, m = table.sets, table.trained
    size = np.bincount(sets.fit, minlength=sets.n)
    base = np.cumsum(size) - size
    draw, last, many = np.arange(m) - base[sets.fit], sets.row[base + size - 1][sets.fit], size[sets.fit].astype(np.uint64)
    target, total = y[sets.row], np.zeros(len(sets.test_fit))
    for t in range(trees):
        chosen = base[sets.fit] + (mixed(seed, t, last, size[sets.fit], draw) % many).astype(np.int64)
        total += grow(table, target, np.bincount(chosen, minlength=m).astype(float), depth)[m:]
    return total / trees


def boosted(table: Table, y: np.ndarray, rounds: int, depth: int, rate: float) -> np.ndarray:
    """Prediction for the test entries of trees that follow one another on what is left of the target."""
    sets, m = table.sets, table.trained
    target = y[sets.row]
    out = (np.bincount(sets.fit, target, sets.n) / np.bincount(sets.fit, minlength=sets.n))[table.fit]
    for _ in range(rounds):
        out = out + rate * grow(table, target - out[:m], None, depth)
    return out[m:]
