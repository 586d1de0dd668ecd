"""Mixtures that follow a stream, held as sums.

A part of a mixture is the weight of its rows, their weighted sum and their weighted sum of squares; mean and
covariance follow from these. So taking in a row, merging two parts and taking one out of another are additions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gaussian import Gaussians
from .pairs import matrix


@dataclass(frozen=True)
class Part:
    weight: float
    first: np.ndarray
    second: np.ndarray
    rows: float

    @classmethod
    def of(cls, mu: np.ndarray, s: np.ndarray, weight: float, rows: float) -> Part:
        """From mean and covariance."""
        mu = np.asarray(mu, float)
        return cls(float(weight), mu * weight, (np.asarray(s, float) + np.outer(mu, mu)) * weight, float(rows))

    @property
    def mu(self) -> np.ndarray:
        return self.first / self.weight

    @property
    def s(self) -> np.ndarray:
        return self.second / self.weight - np.outer(self.mu, self.mu)

    @property
    def share(self) -> float:
        return self.weight / self.rows


def updated(c: Part, x: np.ndarray, p: float) -> Part:
    """After one more row of which the part has the share ``p``."""
    return Part(c.weight + p, c.first + p * x, c.second + p * np.outer(x, x), c.rows + 1)


def shifted(c: Part, x: np.ndarray, p: float) -> Part:
    """The mean moved by a row of weight ``p``, the covariance as it is."""
    return Part.of(c.mu + (x - c.mu) * p / c.weight, c.s, c.weight, c.rows)


def moved(parts: Mapping[int, Part], rows: DataFrame, steps: Callable[[np.ndarray], np.ndarray]) -> dict[int, Part]:
    """``parts`` after ``shifted`` by each of ``rows(order, v)`` in their order; ``steps`` gives the rows' weights for each part.

    A move takes a mean m to (1 - a) m + a x, and moves after one another are again of the form A m + B. So each task of
    a range of the order gives A and B for each part, and only these are joined here, in the ranges' order.
    """
    keys = sorted(parts)
    weights = np.array([parts[k].weight for k in keys])
    d = len(parts[keys[0]].first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.ones(len(keys)), np.zeros((len(keys), d))
        for batch in batches:
            x = matrix(pa.table(batch))
            if len(x):
                share = steps(x) / weights
                after = np.cumprod(np.concatenate([np.ones((1, len(keys))), (1 - share)[::-1]]), axis=0)
                a, b = a * after[-1], b * after[-1][:, None] + (share * after[-2::-1]).T @ x
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at] * len(keys), pa.int32()), pa.array(range(len(keys)), pa.int32()), pa.array(a), pa.array(b.tolist(), pa.list_(pa.float64()))], ["at", "k", "a", "b"])

    ordered = rows.select(F.col("order").cast("long").alias("order"), "v").repartitionByRange("order").sortWithinPartitions("order")
    means = [parts[k].mu for k in keys]
    for r in sorted(ordered.mapInArrow(run, "at int, k int, a double, b array<double>").collect(), key=lambda r: r["at"]):
        means[r["k"]] = r["a"] * means[r["k"]] + np.array(r["b"])
    return {k: Part.of(m, parts[k].s, parts[k].weight, parts[k].rows) for k, m in zip(keys, means, strict=True)}


def merged(a: Part, b: Part, sign: int = 1) -> Part:
    """Both as one part; with ``sign`` -1, a without b."""
    return Part(a.weight + sign * b.weight, a.first + sign * b.first, a.second + sign * b.second, a.rows)


def gaussians(parts: Sequence[Part]) -> Gaussians:
    return Gaussians(range(len(parts)), np.array([c.mu for c in parts]), np.array([c.s for c in parts]), np.log([c.share for c in parts]))


def kl(a: Part, b: Part) -> float:
    """Kullback-Leibler divergence of two Gaussians."""
    d, inverse = b.mu - a.mu, np.linalg.pinv(b.s)
    return float(np.trace(inverse @ a.s) + d @ inverse @ d - len(d) + np.linalg.slogdet(b.s)[1] - np.linalg.slogdet(a.s)[1]) / 2


def symmetric_kl(a: Part, b: Part) -> float:
    return (kl(a, b) + kl(b, a)) / 2


def _root(s: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(s)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def mean_distance(a: Part, b: Part) -> float:
    """The distance of the means plus the trace of S0 + S1 - 2 (S0^1/2 S1 S0^1/2)^1/2."""
    r = _root(a.s)
    return float(np.linalg.norm(a.mu - b.mu) + np.trace(a.s + b.s - 2 * _root(r @ b.s @ r)))


def to_nearest_model(parts: Sequence[Part], models: Sequence[Part]) -> float:
    """The parts' distances to their nearest model, weighted by the parts' shares."""
    return float(sum(c.share * min(mean_distance(c, m) for m in models) for c in parts))


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """The least cost of moving shares ``supply`` to shares ``demand``: successive shortest paths over a few nodes."""
    n, m = cost.shape
    flow, left, open_ = np.zeros((n, m)), supply / supply.sum(), demand / demand.sum()
    small = 1e-9 * max(float(np.abs(cost).max()), 1e-9)  # of distances; of shares it is 1e-10
    while left.max() > 1e-10 and open_.max() > 1e-10:
        # Bellman and Ford's distances from all sources with supply left; edges back where there is flow.
        far_s, far_d = np.where(left > 1e-10, 0.0, np.inf), np.full(m, np.inf)
        from_s, from_d = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):
            ahead = far_s[:, None] + cost
            better = ahead.min(axis=0) < far_d - small
            from_d[better], far_d[better] = ahead.argmin(axis=0)[better], ahead.min(axis=0)[better]
            back = np.where(flow > 1e-10, far_d[None, :] - cost, np.inf)
            turn = back.min(axis=1) < far_s - small
            from_s[turn], far_s[turn] = back.argmin(axis=1)[turn], back.min(axis=1)[turn]
            if not better.any() and not turn.any():
                break
        end = int(np.where(open_ > 1e-10, far_d, np.inf).argmin())
        path, node, amount = [], end, open_[end]
        while True:
            source = int(from_d[node])
            path.append((source, node, 1))
            if from_s[source] < 0:
                amount = min(amount, left[source])
                break
            path.append((source, int(from_s[source]), -1))
            amount, node = min(amount, flow[source, from_s[source]]), int(from_s[source])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[path[-1][0]] -= amount
        open_[end] -= amount
    return float((flow * cost).sum())


def fit(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42, ridge: float = 1e-6) -> tuple[list[Part], float]:
    """Parts and log-likelihood of some rows in memory, from k spread rows."""
    n, d = x.shape
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = [x[rng.integers(n)]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(n, p=far / far.sum()) if far.sum() else rng.integers(n)])
    spread = np.cov(x.T).reshape(d, d) / k + ridge * np.eye(d)
    parts, last, total = [Part.of(c, spread, n / k, n) for c in centres], -np.inf, -np.inf
    for _ in range(rounds):
        g = gaussians(parts)
        logs = g.log_density(x) + g.log_weight
        top = logs.max(axis=1, keepdims=True)
        share = np.exp(logs - top)
        total = float((np.log(share.sum(axis=1)) + top[:, 0]).sum())
        share /= share.sum(axis=1, keepdims=True)
        parts = []
        for w in share.T:
            weight = max(w.sum(), 1e-9)
            mu = w @ x / weight
            parts.append(Part.of(mu, (x - mu).T @ ((x - mu) * w[:, None]) / weight + ridge * np.eye(d), weight, n))
        if abs(total - last) < 1e-4 * n:
            break
        last = total
    return parts, total


def bic(parts: Sequence[Part], total: float, n: int) -> float:
    k, d = len(parts), len(parts[0].first)
    return (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n) - 2 * total


def best_by_bic(x: np.ndarray, most: int = 10) -> list[Part]:
    """The fit of the least Bayesian information criterion, of 1 to min(most, n // 25 + 1) parts, of rows in memory."""
    found = []
    for k in range(1, min(most, len(x) // 25 + 1) + 1):
        parts, total = fit(x, k)
        found.append((bic(parts, total, len(x)), k, parts))
    return min(found, key=lambda f: f[:2])[2]


def _fit_many(x: np.ndarray, k: int, rounds: int = 100, seed: int = 42, ridge: float = 1e-6) -> list[tuple[list[Part], float]]:
    """``fit`` of each of some windows of equally many rows: one after another in their starts, together in their rounds."""
    m, n, d = x.shape
    mu, s = np.empty((m, k, d)), np.empty((m, k, d, d))
    for w in range(m):
        rng = np.random.Generator(np.random.PCG64(seed))
        centres = [x[w, rng.integers(n)]]
        for _ in range(k - 1):
            far = np.min([((x[w] - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[w, rng.choice(n, p=far / far.sum()) if far.sum() else rng.integers(n)])
        mu[w], s[w] = centres, np.cov(x[w].T).reshape(d, d) / k + ridge * np.eye(d)
    weight, last, total = np.full((m, k), n / k), np.full(m, -np.inf), np.full(m, -np.inf)
    open_ = np.arange(m)
    for _ in range(rounds):
        y = x[open_]
        inverse, log_det = np.linalg.pinv(s[open_]), np.linalg.slogdet(s[open_])[1]
        away = y[:, None] - mu[open_][:, :, None]  # window, part, row, axis
        logs = -(((away @ inverse) * away).sum(axis=3) + log_det[..., None] + d * math.log(2 * math.pi)) / 2 + np.log(weight[open_] / n)[..., None]
        top = logs.max(axis=1, keepdims=True)
        share = np.exp(logs - top)
        sums = share.sum(axis=1, keepdims=True)
        total[open_] = (np.log(sums) + top).sum(axis=(1, 2))
        share /= sums
        w = np.maximum(share.sum(axis=2), 1e-9)
        centre = share @ y / w[..., None]
        away = y[:, None] - centre[:, :, None]
        weight[open_], mu[open_] = w, centre
        s[open_] = np.swapaxes(away, 2, 3) @ (away * share[..., None]) / w[..., None, None] + ridge * np.eye(d)
        settled = np.abs(total[open_] - last[open_]) < 1e-4 * n
        last[open_] = total[open_]
        open_ = open_[~settled]
        if not len(open_):
            break
    return [([Part.of(mu[w, c], s[w, c], weight[w, c], n) for c in range(k)], float(total[w])) for w in range(m)]


def best_of_many(windows: Sequence[np.ndarray], most: int = 10) -> list[list[Part]]:
    """``best_by_bic`` of each window; windows of equally many rows are fitted together."""
    out: list[list[Part]] = [[] for _ in windows]
    sizes = np.array([len(w) for w in windows], np.int64)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        if n < 2 or not all(np.isfinite(windows[w]).all() for w in own):
            for w in own:
                out[w] = best_by_bic(windows[w], most)
            continue
        x, found = np.stack([windows[w] for w in own]), [[] for _ in own]
        for k in range(1, min(most, n // 25 + 1) + 1):
            for tried, (parts, total) in zip(found, _fit_many(x, k), strict=True):
                tried.append((bic(parts, total, int(n)), k, parts))
        for w, tried in zip(own, found, strict=True):
            out[w] = min(tried, key=lambda f: f[:2])[2]
    return out


class Follower:
    """A mixture that takes rows one by one.

    A row goes to its best part if its score is below that one's relaxed threshold, and changes all parts by
    their posteriors if it is below the strict one; else it is uncertain. When more rows than ``trigger`` (or a
    twelfth of all) are uncertain, they get parts of their own; of more than four new ones the largest stay.
    """

    def __init__(self, comps: list[Part], x: np.ndarray, trigger: int = 200):
        self.comps, self.trigger, self.n = list(comps), trigger, len(x)
        self.uncertain: list[list[float]] = []
        self.limits = limits(gaussians(self.comps).score(x, True) if len(x) else np.zeros((0, len(self.comps))))

    @property
    def comps(self) -> list[Part]:
        """The parts; they are held as columns of sums, so that a row changes all of them in one addition."""
        d = self._d
        return [Part(float(c[0]), c[1 : d + 1].copy(), c[d + 1 :].reshape(d, d).copy(), float(n)) for c, n in zip(self._sums.T, self._rows, strict=True)]

    @comps.setter
    def comps(self, parts: list[Part]) -> None:
        self._d = len(parts[0].first)
        self._sums = np.array([[c.weight, *c.first, *np.ravel(c.second)] for c in parts], float).T.copy()
        self._rows = np.array([c.rows for c in parts], float)

    def _far(self, x: np.ndarray) -> np.ndarray:
        """As ``Gaussians.score`` of one row; covariances of two axes are inverted in place unless they are close to singular."""
        if self._d == 2:
            m = self._sums[1:] / self._sums[0]
            aa, ab, bb = m[2] - m[0] * m[0], m[3] - m[0] * m[1], m[5] - m[1] * m[1]
            around = aa * bb
            det = around - ab * ab
            if (det > 1e-10 * around).all() and aa.min() > 0:
                u, v = x[0] - m[0], x[1] - m[1]
                return (bb * u * u - 2 * ab * u * v + aa * v * v) / det + np.log(det)
        return gaussians(self.comps).score(x[None])[0]

    def add(self, x: np.ndarray) -> tuple[int, bool]:
        """The row's part, and whether it is uncertain."""
        far, log_share = self._far(x), np.log(self._sums[0] / self._rows)
        scores = far - log_share
        k = int(scores.argmin())
        self.n += 1
        if scores[k] >= self.limits[k][0]:
            self.uncertain.append(x.tolist())
            if len(self.uncertain) > max(self.trigger, self.n // 12):
                rows = np.array(self.uncertain)
                made = sorted(best_by_bic(rows, min(7, 1 + round(len(rows) / 50))), key=lambda c: -c.weight)[:4]
                self.comps = self.comps + made
                self.limits += limits(gaussians(self.comps).score(rows, True))[-len(made) :]
                self.uncertain = []
            return k, True
        if scores[k] < self.limits[k][1]:
            logs = log_share - far / 2
            p = np.exp(logs - logs.max())
            self._sums += np.concatenate([[1.0], x, np.outer(x, x).ravel()])[:, None] * (p / p.sum())
            self._rows += 1
        return k, False

    def dump(self) -> str:
        """The whole state as JSON."""
        comps = [[c.weight, c.first.tolist(), c.second.tolist(), c.rows] for c in self.comps]
        return json.dumps({"comps": comps, "limits": self.limits, "uncertain": self.uncertain, "trigger": self.trigger, "n": self.n})

    @classmethod
    def loaded(cls, text: str) -> Follower:
        state = json.loads(text)
        made = cls.__new__(cls)
        made.comps = [Part(w, np.array(a), np.array(b), n) for w, a, b, n in state["comps"]]
        made.limits, made.uncertain, made.trigger, made.n = [tuple(x) for x in state["limits"]], state["uncertain"], state["trigger"], state["n"]
        return made


def followed(rows: DataFrame, first: int, most: int) -> DataFrame:
    """(label, t, component, uncertain) of ``rows(label, t, v)``: each label's rows one by one, after a fit of its first ``first`` rows with ``most`` parts at most.

    A label's rows change its mixture one after another, so labels are what runs side by side, each in a task of its own,
    which reads its rows in order and holds the mixture and one batch.
    """
    rows = rows.select(F.col("label").cast("string").alias("label"), F.col("t").cast("long").alias("t"), "v")
    labels = sorted(r[0] for r in rows.select("label").where("label is not null").distinct().collect())
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), F.col("label")), F.lit(0))
    schema = pa.schema([("label", pa.string()), ("t", pa.int64()), ("component", pa.int32()), ("uncertain", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, label, begun = None, None, False
        waiting: list[tuple[int, np.ndarray]] = []

        def start() -> list[tuple[int, int, bool]]:
            nonlocal follower
            x = np.array([v for _, v in waiting])
            follower = Follower(best_by_bic(x, most), x)
            found = gaussians(follower.comps).score(x, True).argmin(axis=1)
            out = [(t, int(k), False) for (t, _), k in zip(waiting, found, strict=True)]
            waiting.clear()
            return out

        def made(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([label] * len(out), pa.string()), *[pa.array([r[k] for r in out], schema.field(k + 1).type) for k in range(3)]], schema=schema)

        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for name, t, v in zip(batch.column("label").to_pylist(), batch.column("t").to_pylist(), matrix(pa.table(batch)), strict=True):
                if not begun or name != label:
                    if waiting:
                        out += start()
                    if out:
                        yield made(out)
                    follower, label, begun, out = None, name, True, []
                if follower is None:
                    waiting.append((t, v.copy()))
                    if len(waiting) == first:
                        out += start()
                else:
                    out.append((t, *follower.add(v)))
            if out:
                yield made(out)
        if waiting:
            yield made(start())

    dealt = rows.repartitionById(len(labels) + 1, place.cast("int")) if len(labels) <= 256 else rows.repartition("label")
    return dealt.sortWithinPartitions("label", "t").mapInArrow(run, "label string, t long, component int, uncertain boolean")


def limits(scores: np.ndarray) -> list[tuple[float, float]]:
    """Relaxed and strict thresholds of each part from its own rows' scores."""
    best = scores.argmin(axis=1) if len(scores) else np.zeros(0, int)
    out = []
    for k in range(scores.shape[1]):
        own = scores[best == k, k] if (best == k).any() else np.array([1e-5])
        relax = own.max() + (own.max() - own.min()) / 100 if scores.shape[1] > 5 else np.quantile(own, 0.95)
        out.append((float(relax), float(np.quantile(own, 0.9))))
    return out
