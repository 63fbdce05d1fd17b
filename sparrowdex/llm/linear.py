"""Logistic regression over sparse rows in numpy, and the spans of rows it is fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Binary entries (row, column) of `rows` rows; values default to 1."""

    rows: int
    columns: int
    row: np.ndarray
    column: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.rows)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.columns)

    def take(self, keep: np.ndarray) -> Sparse:
        """The rows that the mask keeps, numbered anew."""
        place = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Sparse(int(keep.sum()), self.columns, place[self.row[mine]], self.column[mine])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Logistic:
    weights: np.ndarray  # of the sparse columns
    dense: np.ndarray  # of the dense columns
    bias: float

    def predict(self, x: Sparse, d: np.ndarray) -> np.ndarray:
        return sigmoid(x.times(self.weights) + d @ self.dense + self.bias)


def fit_logistic(x: Sparse, d: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 200) -> Logistic:
    """Accelerated gradient descent on the ridge-penalised mean log loss of rows that weigh both classes alike."""
    n, k = len(y), d.shape[1]
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        return Logistic(np.zeros(x.columns), np.zeros(k), float(np.log((share * n + 0.5) / (n - share * n + 0.5))))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, v = np.zeros(x.columns + k + 1), np.zeros(x.columns + k + 1)
    # each step is at most 1 / the largest curvature, bounded by the heaviest rows' squared lengths
    longest = np.bincount(x.row, minlength=n) + (d**2).sum(1) + 1
    rate = 1 / (0.25 * float((weight * longest).sum()) + ridge / n)
    t = 1.0
    for _ in range(steps):
        p = sigmoid(x.times(v[: x.columns]) + d @ v[x.columns : -1] + v[-1])
        r = weight * (p - y)
        g = np.concatenate([x.transposed_times(r), d.T @ r, [r.sum()]]) + np.append(np.full(len(v) - 1, ridge / n), 0) * v
        new = v - rate * g
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return Logistic(w[: x.columns], w[x.columns : -1], float(w[-1]))
