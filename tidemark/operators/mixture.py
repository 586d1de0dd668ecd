"""Mixture components of any number of axes: moments, fits, assignment, thresholds, pruning and merging.

Points are (t, v), with v an array of doubles. Components are few rows of (key, n, mu, s, log_det, log_weight), with
s the covariance row after row. Points are scored in Arrow batches against the components, which go to the tasks in
blocks of HELD_BYTES: one as a rule; of more, each point's best of every block is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gaussian import Gaussians
from ..sources.kept import drop, keep
from .prepare import with_stats
from .quantiles import exact_quantiles

#: Bytes of components that a task may hold.
HELD_BYTES = 64 << 20


def matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    """An array column of equally long arrays as rows."""
    column = batch.column(name)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _total(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mu, m2) of partial ones, each with its own mean: two parts' squares add, and so does the square between their means."""
    import pandas as pd

    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        n, mu = group["n"].to_numpy(float), np.stack(group["mu"])
        mean = n @ mu / n.sum()
        away = mu - mean
        m2 = np.stack(group["m2"]).sum(axis=0) + ((away * n[:, None]).T @ away).ravel()
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "n": [n.sum()], "mu": [mean], "m2": [m2]})

    return parts.groupBy(*keys).applyInPandas(add, f"{kinds}, n double, mu array<double>, m2 array<double>")


def moments(points: DataFrame, by: str = "label") -> DataFrame:
    """(by, n, mu, s, log_det) of points(by, v): counts, means, sample covariances and their log-determinants.

    Each task sums its rows; a row for each task and group is shuffled.
    """
    kind = points.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x, keys = matrix(batch), np.array(batch.column(by).to_pylist(), object)
            for key in set(keys.tolist()):
                own = x[[k == key for k in keys]]
                mean = own.mean(axis=0)
                n, mu, m2 = len(own), mean, (own - mean).T @ (own - mean)
                if key in held:
                    n0, mu0, m0 = held[key]
                    gap, total = mu - mu0, n + n0
                    n, mu, m2 = total, mu0 + gap * n / total, m0 + m2 + np.outer(gap, gap) * n0 * n / total
                held[key] = n, mu, m2
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), type=batch_type), pa.array([float(n) for n, _, _ in held.values()], pa.float64()), pa.array([mu.tolist() for _, mu, _ in held.values()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist() for _, _, m2 in held.values()], pa.list_(pa.float64()))],
            [by, "n", "mu", "m2"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(points.schema[by].dataType)
    total = _total(points.select(by, "v").mapInArrow(run, f"{by} {kind}, n double, mu array<double>, m2 array<double>"), [by])

    @F.pandas_udf("double")
    def log_determinant(s):
        import pandas as pd

        return pd.Series([float(np.linalg.slogdet(np.reshape(x, (math.isqrt(len(x)),) * 2))[1]) for x in s], dtype=float)

    s = F.transform("m2", lambda x: x / (F.col("n") - 1))
    return total.select(by, F.col("n").cast("long").alias("n"), "mu", s.alias("s")).withColumn("log_det", log_determinant("s"))


def components(points: DataFrame, by: str = "label") -> DataFrame:
    """Moments with log_weight, of groups of three rows or more."""
    m = moments(points, by).where("n >= 3")
    return with_stats(m, F.sum("n").alias("all")).withColumn("log_weight", F.log(F.col("n") / F.col("all"))).drop("all")


def held(comps: DataFrame, key: str = "label") -> Iterator[Gaussians]:
    """All components, by HELD_BYTES at a time, in the order of their keys."""
    size = comps.agg(F.sum(F.size("s") * 16 + 64)).first()[0] or 0
    n = max(1, -(-size // HELD_BYTES))
    for b in range(n):
        rows = (comps if n == 1 else comps.where(F.pmod(F.hash(key), F.lit(n)) == b)).collect()
        yield Gaussians.of_rows(sorted((r.asDict() for r in rows), key=lambda r: r[key]), key)


def _over(points: DataFrame, fields: list[tuple[str, str]], make: Callable[[np.ndarray, pa.RecordBatch], list]) -> DataFrame:
    """A row or more for each point: ``make`` gives columns from the points' vectors and their batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(matrix(batch), batch)
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    return points.mapInArrow(run, schema)


def assign(points: DataFrame, comps: DataFrame, key: str = "label", weighted: bool = True) -> DataFrame:
    """(t, component, score) of points(t, v): the least of all components' scores (less the log of their weights); ties by key."""
    kind, out, blocks = comps.schema[key].dataType.simpleString(), None, 0
    for block in held(comps, key):

        def best(x: np.ndarray, batch: pa.RecordBatch, block: Gaussians = block) -> list:
            found = block.score(x, weighted) if block.keys else np.zeros((len(x), 0))
            if not block.keys:
                return [pa.array([], pa.int64()), [], []]
            at = found.argmin(axis=1)
            return [batch.column("t"), [block.keys[k] for k in at], found[np.arange(len(x)), at]]

        one = _over(points.select("t", "v"), [("t", "long"), ("component", kind), ("score", "double")], best)
        out, blocks = one if out is None else out.union(one), blocks + 1
    if blocks > 1:
        least = F.min(F.struct("score", "component"))
        out = out.groupBy("t").agg(least.alias("_b")).select("t", F.col("_b")["component"].alias("component"), F.col("_b")["score"].alias("score"))
    return out


def all_scores(points: DataFrame, comps: DataFrame, key: str = "label", value: str = "score") -> DataFrame:
    """(t, key, value) of each point and component; value is score, mahalanobis, log_density or posterior (of components in one block)."""
    kind, out = comps.schema[key].dataType.simpleString(), None
    for block in held(comps, key):

        def run(x: np.ndarray, batch: pa.RecordBatch, block: Gaussians = block) -> list:
            found = getattr(block, value)(x) if block.keys else np.zeros((len(x), 0))
            return [np.repeat(batch.column("t").to_numpy(), len(block.keys)), block.keys * len(x), found.ravel()]

        one = _over(points.select("t", "v"), [("t", "long"), (key, kind), ("value", "double")], run)
        out = one if out is None else out.union(one)
    return out


def own_scores(points: DataFrame, comps: DataFrame, key: str = "label", value: str = "score") -> DataFrame:
    """(t, value) of points(t, v, key) by the component of their own key; a point without one has no row."""
    out = None
    for block in held(comps, key):
        place = {k: i for i, k in enumerate(block.keys)}

        def run(x: np.ndarray, batch: pa.RecordBatch, block: Gaussians = block, place: dict = place) -> list:
            at = [place.get(k, -1) for k in batch.column(key).to_pylist()]
            some = np.array([i for i, k in enumerate(at) if k >= 0], np.int64)
            found = np.empty(len(some))
            for k in {at[i] for i in some}:
                mine = np.array([n for n, i in enumerate(some) if at[i] == k])
                one = Gaussians([block.keys[k]], block.mu[k : k + 1], block.s[k : k + 1], block.log_weight[k : k + 1])
                found[mine] = getattr(one, value)(x[some[mine]])[:, 0]
            return [batch.column("t").take(pa.array(some)), found]

        one = _over(points.select("t", "v", key), [("t", "long"), ("value", "double")], run)
        out = one if out is None else out.union(one)
    return out


def thresholds(assigned: DataFrame, many: bool) -> DataFrame:
    """(component, relax, strict): of few components quantiles, of many the largest score and a hundredth of the range; quantiles by ``exact_quantiles``."""
    assigned = keep(assigned.select("component", "score"), "scores")
    of = lambda share: F.max(F.when(F.col("share") == share, F.col("quantile")))
    found = exact_quantiles(assigned, "component", "score", [0.9] if many else [0.9, 0.95])
    if not many:
        return found.groupBy("component").agg(of(0.95).alias("relax"), of(0.9).alias("strict"))
    ends = assigned.groupBy("component").agg((F.max("score") + (F.max("score") - F.min("score")) / 100).alias("relax"))
    return ends.join(found.select("component", F.col("quantile").alias("strict")), "component")


def matched(counts: DataFrame) -> DataFrame:
    """(new, old) of counts(old, new, n) of rows with both labels: greedily the pair of most rows whose labels are both free, ties by old and then new.

    A pair that is the best of both its labels is taken whatever comes before it, so each round takes all such at once.
    """
    order = [F.desc("n"), F.asc("old"), F.asc("new")]
    rest, found = keep(counts.where("old is not null and new is not null"), "counts"), None
    while not rest.isEmpty():
        best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order))
        taken = keep(rest.withColumn("_o", best("old")).withColumn("_n", best("new")).where("_o = 1 and _n = 1").select("new", "old"), "taken")
        found = taken if found is None else found.unionByName(taken)
        before, rest = rest, keep(rest.join(taken.select("old"), "old", "left_anti").join(taken.select("new"), "new", "left_anti").select("old", "new", "n"), "counts")
        drop(before)
    return rest.select("new", "old") if found is None else found


def prune(labelled: DataFrame, by: str = "label") -> DataFrame:
    """(by, n, keep): groups that are large enough: three quarters (or half, of fewer than five) of an equal share, and 100 at most."""
    counts = labelled.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    wide = with_stats(counts, F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    share = F.floor(F.col("_all") / F.col("_k")) * F.when(F.col("_k") >= 5, 0.75).otherwise(0.5)
    return wide.select(by, "n", (F.col("n") >= F.least(F.lit(100.0), share)).alias("keep"))


def shares(rows: DataFrame, sets: DataFrame, name: str = "none") -> DataFrame:
    """(key, share): of the rows' memberships in ``sets(key, t)``; rows in no set count under ``name``."""
    counts = rows.join(sets, "t", "left").groupBy(F.coalesce(F.col("key").cast("string"), F.lit(name)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return with_stats(counts, F.sum("n").alias("_all")).select("key", (F.col("n") / F.col("_all")).alias("share"))


def softmax(values: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: F.exp(x - top) / total)


# Fits


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Of parts(fold, sums) each fold's sum, place by place: so no row gathers the arrays of all tasks."""
    places = parts.select("fold", F.posexplode("sums").alias("at", "x")).groupBy("fold", "at").agg(F.sum("x").alias("x")).toArrow()
    fold, at, x = (places.column(c).to_numpy() for c in ("fold", "at", "x"))
    out = {}
    for k in np.unique(fold).tolist():
        own = fold == k
        out[k] = np.zeros(int(at[own].max()) + 1)
        out[k][at[own]] = x[own]
    return out


#: Rows from which the first centres of a fit are drawn: a bounded sample; the fit itself is over all rows.
START_ROWS = 2000
#: Components of a fit at most: numbers of fits are multiples of it.
PARTS = 1 << 16


class Fit:
    """A mixture during a fit: components and the log-likelihood of the rows by the ones before."""

    def __init__(self, parts: Gaussians, total: float = -math.inf, n: int = 0):
        self.parts, self.total, self.n = parts, total, n

    def bic(self, n: int) -> float:
        k, d = self.parts.mu.shape
        return (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n) - 2 * self.total


def _start(some: np.ndarray, k: int, ridge: float, seed: int = 42) -> Gaussians:
    """k rows far from each other as means, with a shared covariance."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n, d = some.shape
    centres = [some[rng.integers(n)]]
    for _ in range(k - 1):
        far = np.min([((some - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(some[rng.choice(n, p=far / far.sum()) if far.sum() else rng.integers(n)])
    spread = np.cov(some.T).reshape(d, d) / k + ridge * np.eye(d) if n > 1 else np.eye(d)
    return Gaussians(range(k), np.array(centres), np.array([spread] * k), np.full(k, -math.log(k)))


def fit(points: DataFrame, starts: list[Gaussians], rounds: int = 40, tolerance: float = 1e-3, ridge: float = 1e-6) -> list[Fit]:
    """Mixtures of points(v) by expectation and maximisation from each of ``starts``, all in the same passes.

    A round is one job over all rows: each task sums posteriors, and rows and squares about the means by them. A fit ends
    when its log-likelihood gains less than ``tolerance`` a row.
    """
    points = points.select("v")
    fits = [Fit(s) for s in starts]
    going = list(range(len(fits)))
    for _ in range(rounds):
        if not going:
            break
        now = {i: fits[i].parts for i in going}

        def expect(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            sums = {i: [np.zeros(len(g.keys)), np.zeros_like(g.mu), np.zeros_like(g.s), 0.0, 0] for i, g in now.items()}
            for batch in batches:
                x = matrix(batch)
                for i, g in now.items():
                    logs = g.log_density(x) + g.log_weight
                    top = logs.max(axis=1, keepdims=True)
                    share = np.exp(logs - top)
                    s = sums[i]
                    s[3] += float((np.log(share.sum(axis=1)) + top[:, 0]).sum())
                    s[4] += len(x)
                    share /= share.sum(axis=1, keepdims=True)
                    s[0] += share.sum(axis=0)
                    for k in range(len(g.keys)):
                        away = x - g.mu[k]
                        s[1][k] += share[:, k] @ away
                        s[2][k] += (away * share[:, [k]]).T @ away
            keys = [(i, k) for i, s in sums.items() if s[4] for k in range(len(s[0]))]
            rows = [[float(s[0][k]), s[3] if k == 0 else 0.0, float(s[4]) if k == 0 else 0.0, *s[1][k].tolist(), *s[2][k].ravel().tolist()] for s, k in ((sums[i], k) for i, k in keys)]
            yield pa.RecordBatch.from_arrays([pa.array([i * PARTS + k for i, k in keys], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["fold", "sums"])

        rows = summed(points.mapInArrow(expect, "fold int, sums array<double>"))
        if not rows:
            return fits
        for i in list(going):
            own = np.stack([rows[k] for k in sorted(rows) if k // PARTS == i])
            g, total, n = now[i], own[:, 1].sum(), round(own[:, 2].sum())
            d = g.mu.shape[1]
            w = np.maximum(own[:, 0], 1e-9)
            step = own[:, 3 : 3 + d] / w[:, None]
            s = own[:, 3 + d :].reshape(-1, d, d) / w[:, None, None] - step[:, :, None] * step[:, None, :] + ridge * np.eye(d)
            if total - fits[i].total < tolerance * n:
                going.remove(i)
                fits[i] = Fit(g, max(total, fits[i].total), n)
            else:
                fits[i] = Fit(Gaussians(g.keys, g.mu + step, s, np.log(w / w.sum())), total, n)
    return fits


def best_by_bic(points: DataFrame, most: int = 10, ridge: float = 1e-6) -> Fit:
    """The fit of points(t, v) with the least Bayesian information criterion, of 1 to min(most, n // 25 + 1) components."""
    n = points.count()
    some = np.array([r.v for r in points.orderBy(F.xxhash64("t"), "t").limit(START_ROWS).collect()], float)
    fits = fit(points, [_start(some, k, ridge) for k in range(1, min(most, n // 25 + 1) + 1)], ridge=ridge)
    return min(fits, key=lambda f: (f.bic(max(n, 1)), len(f.parts.keys)))


def frame(points: DataFrame, parts: Gaussians, n: float) -> DataFrame:
    """Components as rows: (label, n, mu, s, log_det, log_weight)."""
    made = [(int(k), float(n), mu.tolist(), s.ravel().tolist(), float(d), float(w)) for k, mu, s, d, w in zip(parts.keys, parts.mu, parts.s, parts.log_det, parts.log_weight, strict=True)]
    return points.sparkSession.createDataFrame(made, "label int, n double, mu array<double>, s array<double>, log_det double, log_weight double")


def built(points: DataFrame, most: int = 10, start: Gaussians | None = None, n_keep: int | None = None) -> tuple[Gaussians, DataFrame]:
    """A mixture of points(t, v), fitted by BIC or from ``start``, without its small components, and (t, component, uncertain).

    Components that ``prune`` would drop go (from a ``start`` only those beyond the ``n_keep`` largest, ties kept). Their
    rows go to the nearest other one, and are uncertain where their score is above the 95 % quantile of its own rows.
    """
    parts = best_by_bic(points, most).parts if start is None else fit(points, [start])[0].parts
    placed = assign(points, frame(points, parts, 0)).persist()
    counts = {r["component"]: r["n"] for r in placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    least = min(100, total // max(len(counts), 1) * (0.75 if len(counts) >= 5 else 0.5)) if start is None else 0
    keys = [k for k in parts.keys if counts.get(k, 0) >= max(least, 1)]
    if n_keep is not None and len(keys) > n_keep:
        bound = sorted((counts[k] for k in keys), reverse=True)[n_keep - 1]
        keys = [k for k in keys if counts[k] >= bound]
    at = [parts.keys.index(k) for k in keys]
    weight = np.exp(parts.log_weight[at])
    left = Gaussians(keys, parts.mu[at], parts.s[at], np.log(weight / weight.sum()))
    again = assign(points, frame(points, left, 0)).withColumnsRenamed({"component": "_c", "score": "_s"}).join(placed, "t")
    own = again.where(F.col("component").isin(keys) & (F.col("_c") == F.col("component"))).groupBy("_c").agg(F.percentile("_s", F.lit(0.95)).alias("_limit")).withColumnRenamed("_c", "_l")
    moved = ~F.col("component").isin(keys)
    joined = again.join(F.broadcast(own), F.col("_c") == F.col("_l"), "left")
    out = joined.select("t", F.when(moved, F.col("_c")).otherwise(F.col("component")).alias("component"), (moved & (F.col("_s") > F.coalesce("_limit", F.lit(0.0)))).alias("uncertain"))
    return left, out
