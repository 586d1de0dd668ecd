"""Support vector machines with a radial kernel and probabilities, of many folds in joint passes.

A machine's function is a sum of kernels at LANDMARKS rows at most (all rows, if they are so few; else those of the least
hashes), and, against each of the classes, the one of least half squared norm plus ``cost`` times the squares of what margins
fall short of 1. Newton's method on the rows that fall short needs a few jobs, each summing all folds' derivatives. Rows
with no shortfall add nothing, so at the end those that do are the support.

Decisions become probabilities as Platt has them: a logistic function of the decision, its two numbers fitted on the rows
that a fold was not trained on (on all rows, if there are none). Of several classes the probabilities are made to sum to 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixture import matrix, summed
from .models import flags_of

LANDMARKS = 256


@dataclass
class Machines:
    """``weights[fold, class]`` over the landmarks' features and a constant; ``platt[fold, class]``: slope and constant of the logistic function."""

    classes: list[str]
    mean: np.ndarray
    scale: np.ndarray
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))
    platt: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 2)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))

    def inputs(self, f: np.ndarray) -> np.ndarray:
        """Features whose products are the kernel's values (between landmarks exactly), and a constant."""
        x = (f - self.mean) / self.scale
        d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ self.landmarks.T + (self.landmarks**2).sum(axis=1), 0)
        return np.concatenate([np.exp(-self.gamma * d) @ self.root, np.ones((len(x), 1))], axis=1)

    def of(self, folds: Sequence[int]) -> Machines:
        """Some folds' machines."""
        at = list(folds)
        return replace(self, weights=self.weights[at], platt=self.platt[at], seen=self.seen[at])

    def decisions(self, x: np.ndarray, fold: int) -> np.ndarray:
        """Row by class, from ``inputs``."""
        return x @ self.weights[fold].T

    def probabilities(self, x: np.ndarray, fold: int) -> np.ndarray:
        """Of each class; a class that a fold did not see has none, and one seen alone has all."""
        slope, constant = self.platt[fold].T
        p = (0.5 + 0.5 * np.tanh(0.5 * (self.decisions(x, fold) * slope + constant))) * self.seen[fold]
        if self.seen[fold].sum() == 1:
            p = np.repeat(self.seen[fold][None].astype(float), len(x), axis=0)
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def fit(rows: DataFrame, classes: Sequence[str], cost: float = 1.0, gamma: float | None = None, balanced: bool = True, landmarks: int = LANDMARKS, rounds: int = 25) -> Machines:
    """Fit rows(t, f, label, train) for every flag of ``train``, after scaling; ``gamma`` is one over the number of features if not given.

    ``balanced``: each class of a fold weighs the same in sum.
    """
    classes, index = list(classes), {c: k for k, c in enumerate(classes)}
    first = rows.first()
    if first is None:
        raise ValueError("a model needs rows")
    d, folds, kinds = len(first["f"]), len(first["train"]), len(classes)
    stats = rows.agg(F.count(F.lit(1)), *[g(F.col("f")[k]) for g in (F.avg, F.stddev_pop) for k in range(d)]).first()
    mean, deviation = np.array(stats[1 : 1 + d], float), np.array(stats[1 + d :], float)
    scale = np.where(deviation > 0, deviation, 1.0)
    chosen = rows.select("t", "f").orderBy(F.xxhash64("t"), "t").limit(landmarks).toArrow()
    points = np.unique((np.array(chosen.column("f").to_pylist(), float) - mean) / scale, axis=0)
    made = Machines(classes, mean, scale, gamma or 1.0 / d, points, np.eye(len(points)))
    values, vectors = np.linalg.eigh(made.inputs(points * scale + mean)[:, :-1])
    some = values > 1e-10 * max(values.max(), 1.0)
    made.root = vectors[:, some] / np.sqrt(values[some])
    width = made.root.shape[1] + 1

    def each(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        """Sums of ``of(inputs, labels, flags)`` by fold times class."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, flags = made.inputs(matrix(batch, "f")), flags_of(batch, "train")
            y = np.array([index[c] for c in batch.column("label").to_pylist()], np.int64)
            for key, one in of(x, y, flags):
                sums[key] = sums[key] + one if key in sums else one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["fold", "sums"])

    def passed(of) -> dict[int, np.ndarray]:
        return summed(rows.select("f", "label", "train").mapInArrow(lambda batches: each(batches, of), "fold int, sums array<double>"))

    counts = passed(lambda x, y, flags: ((k, np.bincount(y[flags[:, k]], minlength=kinds).astype(float)) for k in range(folds)))
    counts = np.stack([counts.get(k, np.zeros(kinds)) for k in range(folds)])
    made.seen = counts > 0
    weigh = np.where(made.seen, counts.sum(axis=1, keepdims=True) / np.maximum(counts, 1) / np.maximum(made.seen.sum(axis=1, keepdims=True), 1), 0.0) if balanced else made.seen.astype(float)
    made.weights, made.platt = np.zeros((folds, kinds, width)), np.tile([1.0, 0.0], (folds, kinds, 1))
    going = {(k, c) for k in range(folds) for c in range(kinds) if made.seen[k, c] and made.seen[k].sum() > 1}
    held = np.ones(width)
    held[-1] = 1e-6  # the constant is hardly held
    best, least = made.weights.copy(), np.full((folds, kinds), np.inf)
    for _ in range(rounds):
        if not going:
            break
        now, targets = made.weights, sorted(going)

        def slopes(x: np.ndarray, y: np.ndarray, flags: np.ndarray, now: np.ndarray = now, targets: list = targets) -> Iterator:
            for k, c in targets:
                own = flags[:, k]
                sign = np.where(y[own] == c, 1.0, -1.0)
                short = 1 - sign * (x[own] @ now[k, c])
                at = short > 0
                w, xs = weigh[k][y[own]][at], x[own][at]
                yield k * kinds + c, np.concatenate([[(w * short[at] ** 2).sum()], xs.T @ (w * sign[at] * short[at]), ((xs * w[:, None]).T @ xs).ravel()])

        found = passed(slopes)
        for k, c in targets:
            sums = found.get(k * kinds + c, np.zeros(1 + width + width * width))
            here = made.weights[k, c]
            loss = 0.5 * (held * here * here).sum() + cost * sums[0]
            if loss > least[k, c] * (1 + 1e-12):  # too far: half the way back
                made.weights[k, c] = (here + best[k, c]) / 2
                continue
            if least[k, c] - loss < 1e-8 * max(loss, 1e-9):
                going.discard((k, c))
            least[k, c], best[k, c] = loss, here.copy()
            slope = held * here - 2 * cost * sums[1 : 1 + width]
            made.weights[k, c] = here - np.linalg.solve(np.diag(held) + 2 * cost * sums[1 + width :].reshape(width, width), slope)
    made.weights = best
    _calibrate(made, passed, folds, kinds)
    return made


def _calibrate(made: Machines, passed, folds: int, kinds: int, rounds: int = 20) -> None:
    """Platt's two numbers for each fold and class, by Newton's method on what the fold left out; targets are drawn from 0 and 1 by the counts."""
    many = passed(lambda x, y, flags: ((k, np.concatenate([np.bincount(y[~flags[:, k]], minlength=kinds), np.bincount(y, minlength=kinds)]).astype(float)) for k in range(folds)))
    outside = {k: many[k][:kinds].sum() > 0 and (many[k][:kinds] > 0).sum() > 1 for k in many}
    totals = {k: many[k][:kinds] if outside[k] else many[k][kinds:] for k in many}
    for _ in range(rounds):
        now = made.platt.copy()

        def slopes(x: np.ndarray, y: np.ndarray, flags: np.ndarray, now: np.ndarray = now) -> Iterator:
            for k in range(folds):
                own = ~flags[:, k] if outside[k] else np.ones(len(x), bool)
                decided = made.decisions(x[own], k)
                for c in range(kinds):
                    yes = totals[k][c]
                    no = totals[k].sum() - yes
                    target = np.where(y[own] == c, (yes + 1) / (yes + 2), 1 / (no + 2))
                    f = decided[:, c]
                    p = 0.5 + 0.5 * np.tanh(0.5 * (now[k, c, 0] * f + now[k, c, 1]))
                    gap, v = p - target, p * (1 - p)
                    yield k * kinds + c, np.array([(gap * f).sum(), gap.sum(), (v * f * f).sum(), (v * f).sum(), v.sum()])

        most = 0.0
        for key, (ga, gb, haa, hab, hbb) in passed(slopes).items():
            step = np.linalg.solve(np.array([[haa + 1e-6, hab], [hab, hbb + 1e-6]]), [ga, gb])
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))  # no wild steps where all is decided
            made.platt[key // kinds, key % kinds] -= step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-6:
            break
