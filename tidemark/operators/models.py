"""Classifiers of a selection's folds: multinomial logistic regression, all folds in the same passes.

Rows are (t, f, label, train): f an array of features, train an array of flags, one for each fold. A round of
Newton's method is one job over all rows: each task sums gradients and second derivatives of every fold, so 200 folds
cost no more passes than one. Features are scaled by their means and deviations. With ``gamma`` the regression is on random
Fourier features of a radial kernel; ``kernel`` has support vector machines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixture import matrix, summed

#: Random features that stand for a radial kernel.
WAVES = 64


def fold_flags(t: Column, folds: int, rate: float) -> Column:
    """An array of a repeatable split's flags, one for each fold; the split of ``prepare.fold_flags``."""
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    return F.transform(every, lambda fold: (t * 31 + fold * 17 + F.floor(t / 10) * 7) % 10 < rate * 10)


@dataclass
class Models:
    """A fold's classifier each: ``weights[fold]`` has a row for each class; ``seen[fold]`` are the classes it was trained on."""

    classes: list[str]
    mean: np.ndarray
    scale: np.ndarray
    gamma: float | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))
    seen: list[list[int]] = field(default_factory=list)

    def inputs(self, f: np.ndarray) -> np.ndarray:
        """Scaled features (or waves of them) and a constant."""
        x = (f - self.mean) / self.scale
        if self.gamma is not None:
            rng = np.random.Generator(np.random.PCG64(42))
            x = np.sqrt(2 / WAVES) * np.cos(f @ rng.normal(0, np.sqrt(2 * self.gamma), (f.shape[1], WAVES)) + rng.uniform(0, 2 * np.pi, WAVES))
        return np.concatenate([x, np.ones((len(x), 1))], axis=1)

    def of(self, folds: Sequence[int]) -> Models:
        """Some folds' classifiers."""
        return replace(self, weights=self.weights[list(folds)], seen=[self.seen[k] for k in folds])

    def probabilities(self, x: np.ndarray, fold: int) -> np.ndarray:
        """Of each class, from ``inputs``. A fold that saw one class only gives that one; a class it did not see has none."""
        seen, out = self.seen[fold], np.zeros((len(x), len(self.classes)))
        if len(seen) == 1:
            out[:, seen[0]] = 1.0
        elif seen:
            logits = x @ self.weights[fold][seen].T
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[:, seen] = e / e.sum(axis=1, keepdims=True)
        return out


def flags_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), bool).reshape(batch.num_rows, -1)


def fit(rows: DataFrame, classes: Sequence[str], balanced: bool = True, gamma: float | None = None, ridge: float = 1.0, rounds: int = 15) -> Models:
    """Fit rows(f, label, train) for every flag of ``train``; ``balanced``: each class of a fold weighs the same in sum."""
    rows = rows.select("f", "label", "train")
    index = {c: k for k, c in enumerate(classes)}
    kinds = len(index)

    def label_ids(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([index[c] for c in batch.column("label").to_pylist()], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per, sums = None, None
        for batch in batches:
            flags, y, f = flags_of(batch, "train"), label_ids(batch), matrix(batch, "f")
            if per is None:
                per, sums = np.zeros((flags.shape[1], kinds)), np.zeros((3, f.shape[1]))
            for k in range(kinds):
                per[:, k] += flags[y == k].sum(axis=0)
            sums += [np.full(f.shape[1], len(f)), f.sum(axis=0), (f * f).sum(axis=0)]
        folds = [] if per is None else [*range(len(per)), -1]
        yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array([] if per is None else [*per.tolist(), sums.ravel().tolist()], pa.list_(pa.float64()))], ["fold", "sums"])

    found = summed(rows.mapInArrow(count, "fold int, sums array<double>"))
    if not found:
        raise ValueError("a model needs rows")
    n, total, squares = found.pop(-1).reshape(3, -1)
    mean = total / n
    deviation = np.sqrt(np.maximum(squares / n - mean**2, 0.0))
    made = Models(list(classes), mean, np.where(deviation > 0, deviation, 1.0), gamma)
    counts = np.stack([found[k] for k in sorted(found)])
    made.seen = [np.flatnonzero(c).tolist() for c in counts]
    width = (WAVES if gamma is not None else len(mean)) + 1
    folds = len(counts)
    weight = np.where(counts > 0, counts.sum(axis=1, keepdims=True) / np.maximum(counts, 1) / np.maximum((counts > 0).sum(axis=1, keepdims=True), 1), 0.0) if balanced else np.ones_like(counts)
    made.weights = np.zeros((folds, kinds, width))
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-4  # the constant is hardly held
    last, best = np.full(folds, np.inf), made.weights.copy()
    going = [k for k in range(folds) if len(made.seen[k]) > 1]
    for _ in range(rounds):
        if not going:
            break
        now = {k: made.weights[k] for k in going}

        def slopes(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                flags, y, x = flags_of(batch, "train"), label_ids(batch), made.inputs(matrix(batch, "f"))
                for k in now:
                    own = flags[:, k]
                    if own.any():
                        xs, ys = x[own], y[own]
                        seen = made.seen[k]
                        p = made.probabilities(xs, k)[:, seen]
                        w = weight[k][ys]
                        hit = np.array([seen.index(c) for c in ys])
                        loss = -(w * np.log(np.maximum(p[np.arange(len(ys)), hit], 1e-300))).sum()
                        gap = p * w[:, None]
                        gap[np.arange(len(ys)), hit] -= w
                        second = np.zeros((len(seen), width, len(seen), width))
                        for a in range(len(seen)):
                            for b in range(a, len(seen)):
                                v = w * p[:, a] * ((a == b) - p[:, b])
                                second[a, :, b] = second[b, :, a] = (xs * v[:, None]).T @ xs
                        one = np.concatenate([[loss], (gap.T @ xs).ravel(), second.ravel()])
                        sums[k] = sums[k] + one if k in sums else one
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["fold", "sums"])

        for k, sums in summed(rows.mapInArrow(slopes, "fold int, sums array<double>")).items():
            seen = made.seen[k]
            size = len(seen) * width
            here = made.weights[k][seen]
            loss = sums[0] + 0.5 * (penalty * here * here).sum()
            if loss > last[k] + 1e-9 * abs(last[k]):  # too far: half the way back
                made.weights[k] = (made.weights[k] + best[k]) / 2
                continue
            if last[k] - loss < 1e-6 * max(abs(loss), 1e-9):
                going.remove(k)
            last[k], best[k] = loss, made.weights[k].copy()
            slope = sums[1 : 1 + size] + (penalty * here).ravel()
            second = sums[1 + size :].reshape(size, size) + np.diag(np.tile(penalty, len(seen)))
            made.weights[k][seen] = here - np.linalg.solve(second, slope).reshape(here.shape)
    made.weights = best
    return made


def dumped(made) -> str:
    """Fitted classifiers of a dataclass of arrays and plain values, as JSON."""
    return json.dumps({f.name: v.tolist() if isinstance(v := getattr(made, f.name), np.ndarray) else v for f in fields(made)})


def restored(kind: type, text: str):
    """What ``dumped`` made of classifiers of a kind."""
    state = json.loads(text)
    return kind(**{f.name: np.array(state[f.name]) if str(f.type) == "np.ndarray" else state[f.name] for f in fields(kind)})


def predict(rows: DataFrame, made, fold: int | None = 0, outside: str | None = None) -> DataFrame:
    """(t, fold, class, proba) of rows(t, f) by one fold of ``Models`` or ``kernel.Machines``, or by every fold for the rows that its flag in ``outside`` leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, t = made.inputs(matrix(batch, "f")), batch.column("t").to_numpy()
            flags = flags_of(batch, outside) if outside else None
            for k in range(len(made.seen)) if fold is None else [fold]:
                own = np.arange(len(t)) if flags is None else np.flatnonzero(~flags[:, k])
                p = made.probabilities(x[own], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(t[own], len(made.classes))), pa.array(np.full(p.size, k), pa.int32()), pa.array(made.classes * len(own), pa.string()), pa.array(p.ravel())], ["t", "fold", "class", "proba"]
                )

    return rows.select("t", "f", *([outside] if outside else [])).mapInArrow(run, "t long, fold int, class string, proba double")


def fit_by_validation(rows: DataFrame, classes: Sequence[str], make: Callable = fit, splits: int = 5, **how):
    """For each fold the best of ``splits`` fits, each on all but a part of the fold's rows, by balanced accuracy on that part."""
    part = F.pmod(F.xxhash64("t"), F.lit(splits))
    every = F.sequence(F.lit(0), F.lit(splits - 1))
    spread = F.flatten(F.transform("train", lambda flag: F.transform(every, lambda s: flag & (part != s))))
    left = F.flatten(F.transform("train", lambda flag: F.transform(every, lambda s: ~(flag & (part == s)))))
    wide = rows.select("t", "f", "label", spread.alias("train"), left.alias("_left"))
    made = make(wide, classes, **how)
    best = F.max(F.struct("proba", "class"))["class"]
    judged = predict(wide, made, None, "_left").groupBy("t", "fold").agg(best.alias("pred")).join(rows.select("t", F.col("label").alias("truth")), "t")
    recall = judged.groupBy("fold", "truth").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("r")).groupBy("fold").agg(F.avg("r").alias("r"))
    score = {r["fold"]: r["r"] for r in recall.collect()}
    chosen = [max(range(f, f + splits), key=lambda k: (score.get(k, -1.0), -k)) for f in range(0, len(made.seen), splits)]
    return made.of(chosen)
