"""Gaussians of any number of axes, scored over many rows at once with numpy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def softmax(values: np.ndarray) -> np.ndarray:
    """Of each row."""
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Gaussians:
    """``mu``: a row each; ``s``: their covariances; singular ones count by their pseudo-inverse."""

    def __init__(self, keys: Sequence, mu: np.ndarray, s: np.ndarray, log_weight: np.ndarray | None = None):
        self.keys, self.mu, self.s = list(keys), np.asarray(mu, float), np.asarray(s, float)
        self.log_weight = np.zeros(len(self.keys)) if log_weight is None else np.asarray(log_weight, float)
        self.inverse = np.linalg.pinv(self.s)
        self.log_det = np.linalg.slogdet(self.s)[1]

    @classmethod
    def of_rows(cls, rows: Sequence, key: str = "label") -> Gaussians:
        """From rows with a key, mu, s (row after row) and perhaps log_weight."""
        d = len(rows[0]["mu"]) if rows else 0
        weights = [r["log_weight"] for r in rows] if rows and "log_weight" in rows[0] else None
        return cls([r[key] for r in rows], np.array([r["mu"] for r in rows]).reshape(-1, d), np.array([r["s"] for r in rows]).reshape(-1, d, d), weights)

    def mahalanobis(self, x: np.ndarray) -> np.ndarray:
        """Squared distances: a row for each of ``x``, a column for each Gaussian."""
        out = np.empty((len(x), len(self.keys)))
        for k, (mu, inverse) in enumerate(zip(self.mu, self.inverse, strict=True)):
            away = x - mu
            out[:, k] = np.einsum("ni,ni->n", away @ inverse, away)
        return out

    def score(self, x: np.ndarray, weighted: bool = False) -> np.ndarray:
        """Squared distance plus log-determinant, less the log of the weight if asked: less is closer."""
        return self.mahalanobis(x) + self.log_det - (self.log_weight if weighted else 0.0)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -(self.score(x) + x.shape[1] * math.log(2 * math.pi)) / 2

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.log_density(x) + self.log_weight)
