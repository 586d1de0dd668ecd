"""Layout in the plane: neighbour probabilities, forces and error on given positions, and the fitted layout.

What is summed over edges of the neighbour graph is a join and a sum. Repulsion, over all pairs, is summed
block by block and leaves each task as one row a point. The fitted layout takes one task and numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import drop, keep
from .mixture import moments
from .pairs import BLOCK, dealt, distances, matrix, nearest
from .prepare import last_rows, with_stats
from .quadtree import SENT, repulsion_by_tree
from .rounds import first_layout, laid_out, next_layout


def bandwidths(near: DataFrame, perplexity: float, steps: int = 100, close: float = 1e-5) -> DataFrame:
    """(i, beta, entropy): of near(i, j, d), where exp(-beta * d) has the entropy of ``perplexity`` equal shares; by bisection.

    All rows of a batch are halved together, until each is close.
    """
    target = math.log(perplexity)
    rows = near.groupBy("i").agg(F.array_sort(F.collect_list("d")).alias("ds"))

    def entropy(beta: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
        share = np.exp(-beta[:, None] * d) * w
        total = share.sum(axis=1)
        return np.log(total) + beta * (d * share).sum(axis=1) / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ds").to_pylist()
            longest = max(map(len, lists), default=1)
            d = np.array([[x - ds[0] for x in ds] + [0.0] * (longest - len(ds)) for ds in lists]).reshape(-1, longest)
            w = np.array([[1.0] * len(ds) + [0.0] * (longest - len(ds)) for ds in lists]).reshape(-1, longest)
            beta, low, high = np.ones(len(d)), np.zeros(len(d)), np.full(len(d), np.inf)
            for _ in range(steps):
                h = entropy(beta, d, w)
                going = np.abs(h - target) > close
                if not going.any():
                    break
                low, high = np.where(going & (h > target), beta, low), np.where(going & (h <= target), beta, high)
                beta = np.where(going, np.where(np.isfinite(high), (low + high) / 2, beta * 2), beta)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(beta), pa.array(entropy(beta, d, w))], ["i", "beta", "entropy"])

    return rows.mapInArrow(run, "i long, beta double, entropy double")


def conditional(near: DataFrame, betas: DataFrame) -> DataFrame:
    """(i, j, p): shares of exp(-beta * d) among each row's neighbours."""
    w = near.join(betas, "i").select("i", "j", F.exp(-F.col("beta") * F.col("d")).alias("w"))
    sums = w.groupBy("i").agg(F.sum("w").alias("all"))
    return w.join(sums, "i").select("i", "j", (F.col("w") / F.col("all")).alias("p"))


def symmetrized(p: DataFrame) -> DataFrame:
    """(i, j, p): p_ij + p_ji over the total."""
    both = p.select("i", "j", "p").union(p.select("j", "i", "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    both = keep(both, "symmetric")  # looked at twice, and the search for neighbours is in it
    return with_stats(both, F.sum("p").alias("_all")).select("i", "j", (F.col("p") / F.col("_all")).alias("p"))


def _placed(edges: DataFrame, at: DataFrame) -> DataFrame:
    a, b = at.toDF("i", "xi", "yi"), at.toDF("j", "xj", "yj")
    moved = edges.join(a, "i").join(b, "j").withColumn("dx", F.col("xi") - F.col("xj")).withColumn("dy", F.col("yi") - F.col("yj"))
    return moved.withColumn("q", 1 / (1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def attraction(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(i, fx, fy): the sum of p * q times the way from each neighbour, at positions at(t, x, y)."""
    f = F.col("p") * F.col("q")
    return _placed(edges, at).groupBy("i").agg(F.sum(f * F.col("dx")).alias("fx"), F.sum(f * F.col("dy")).alias("fy"))


def repulsion(at: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(i, q, fx, fy): sums over all other points of q, and of q * q times the way from them."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("j")
        i, x, y = (a.column(c).to_numpy() for c in ("i", "x", "y"))
        j, x2, y2 = (b.column(c).to_numpy() for c in ("j", "x2", "y2"))
        out, first = np.zeros((3, len(i))), np.searchsorted(j, i)
        same = np.searchsorted(j, i, "right") - first  # a point's own rows on the other side
        space = np.empty((4, 64 * BLOCK))  # made once: all that follows is in place
        for k in range(0, len(i), 64):
            mine = slice(k, k + 64)
            r = np.repeat(np.arange(len(i[mine])), same[mine])
            c = first[mine][r] + np.arange(len(r)) - (np.cumsum(same[mine]) - same[mine])[r]
            for m in range(0, len(j), BLOCK):
                shape = len(i[mine]), len(j[m : m + BLOCK])
                dx, dy, q, square = (v[: shape[0] * shape[1]].reshape(shape) for v in space)
                np.subtract(x[mine, None], x2[None, m : m + BLOCK], out=dx)
                np.subtract(y[mine, None], y2[None, m : m + BLOCK], out=dy)
                np.multiply(dx, dx, out=q)
                np.multiply(dy, dy, out=square)
                q += square
                q += 1
                np.divide(1.0, q, out=q)
                here = (c >= m) & (c < m + BLOCK)
                q[r[here], c[here] - m] = 0.0
                out[0, mine] += q.sum(axis=1)
                q *= q
                out[1, mine] += np.einsum("nm,nm->n", q, dx)
                out[2, mine] += np.einsum("nm,nm->n", q, dy)
        return pa.table([pa.array(i), *[pa.array(v) for v in out]], names=["i", "q", "fx", "fy"])

    both = [at.select(F.col("t").cast("long").alias(t), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y)) for t, x, y in (("i", "x", "y"), ("j", "x2", "y2"))]
    parts = dealt(*both, n_blocks, "i", "j").applyInArrow(run, "i long, q double, fx double, fy double")
    return parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("q", "fx", "fy")])


def gradient(edges: DataFrame, at: DataFrame, repel=repulsion) -> DataFrame:
    """(i, gx, gy): attraction less repulsion over the sum of all q; a point does not repel itself."""
    away = keep(repel(at), "repulsion")  # looked at twice, and it is the dear part
    away = with_stats(away, F.sum("q").alias("_z")).select("i", (F.col("fx") / F.col("_z")).alias("rx"), (F.col("fy") / F.col("_z")).alias("ry"))
    near = attraction(edges, at)
    return away.join(near, "i", "left").select("i", (F.coalesce("fx", F.lit(0.0)) - F.col("rx")).alias("gx"), (F.coalesce("fy", F.lit(0.0)) - F.col("ry")).alias("gy"))


def kl_error(edges: DataFrame, at: DataFrame, small: float = 1e-12, repel=repulsion) -> DataFrame:
    """(error): the sum of p * log(p / q) over edges, q over the sum of all q."""
    total = repel(at).agg(F.sum("q").alias("_z"))
    q = F.col("q") / F.col("_z")
    return _placed(edges, at).join(F.broadcast(total)).agg(F.sum(F.col("p") * F.log((F.col("p") + small) / (q + small))).alias("error"))


def kernel(v: np.ndarray, start: np.ndarray, perplexity: float = 30.0, rounds: int = 300, frozen: int = 0, seed: int = 42) -> np.ndarray:
    """Positions of the rows of ``v``, from ``start``: momentum and gains, at first with exaggeration; ``frozen`` first rows stay."""
    n = len(v)
    if n < 3 or v.shape[1] <= 2:
        return v[:, :2].astype(float) if v.shape[1] >= 2 else start
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    target = math.log(min(perplexity, (n - 1) / 3))
    near = d - d.min(axis=1, keepdims=True)
    for _ in range(60):
        w = np.exp(-near * beta[:, None])
        s = w.sum(axis=1)
        h = np.log(s) + beta * (np.where(np.isfinite(near), near, 0) * w).sum(axis=1) / s
        low, high = np.where(h > target, beta, low), np.where(h > target, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    p = np.exp(-near * beta[:, None])
    p /= p.sum(axis=1, keepdims=True)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = start - start.mean(axis=0)
    y = y / (y[:, 0].std() or 1.0) * 1e-4 if not frozen else y
    y = y + np.random.Generator(np.random.PCG64(seed)).normal(0, 1e-6, y.shape) * (not frozen)
    step, gains = np.zeros_like(y), np.ones_like(y)
    for k in range(rounds):
        way = y[:, None] - y[None]
        q = 1 / (1 + (way**2).sum(axis=2))
        np.fill_diagonal(q, 0)
        pull = 12.0 if k < rounds // 4 else 1.0
        g = (4 * (pull * p - q / q.sum()) * q)[..., None] * way
        g = g.sum(axis=1)
        gains = np.maximum(np.where(step * g < 0, gains + 0.2, gains * 0.8), 0.01)
        step = (0.5 if k < rounds // 4 else 0.8) * step - max(n / 12.0, 50.0) * gains * g
        step[:frozen] = 0
        y = np.floor((y + step) * 1e9) * 1e-9
    return y


def fitted(points: DataFrame, perplexity: float = 30.0, rounds: int = 300) -> DataFrame:
    """(t, x, y) of points(t, v): the layout from the two main axes. All points of one layout are one task's."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        v = np.stack(rows["v"])
        y = kernel(v, principal(v), perplexity, rounds)
        return pd.DataFrame({"t": rows["t"], "x": y[:, 0], "y": y[:, 1]})

    return points.select("t", "v", F.lit(1).alias("_all")).groupBy("_all").applyInPandas(run, "t long, x double, y double")


def stepped(state: DataFrame, g: DataFrame, momentum: float, rate: float) -> DataFrame:
    """state(t, x, y, sx, sy, gx, gy) of positions, last steps and gains after a step along a gradient (i, gx, gy)."""
    wide = state.join(g.toDF("i", "_dx", "_dy"), F.col("t") == F.col("i"))
    gain = lambda a: F.greatest(F.when(F.col(f"s{a}") * F.col(f"_d{a}") < 0, F.col(f"g{a}") + 0.2).otherwise(F.col(f"g{a}") * 0.8), F.lit(0.01))
    wide = wide.withColumns({f"_g{a}": gain(a) for a in "xy"})
    wide = wide.withColumns({f"_s{a}": momentum * F.col(f"s{a}") - rate * F.col(f"_g{a}") * 4 * F.col(f"_d{a}") for a in "xy"})
    place = lambda a: F.floor((F.col(a) + F.col(f"_s{a}")) * 1e9) * 1e-9
    return wide.select("t", place("x").alias("x"), place("y").alias("y"), F.col("_sx").alias("sx"), F.col("_sy").alias("sy"), F.col("_gx").alias("gx"), F.col("_gy").alias("gy"))


def moved(edges: DataFrame, state: DataFrame, pull: float, momentum: float, rate: float, repel=repulsion_by_tree) -> DataFrame:
    """One round of a layout as a job, along the gradient at the positions."""
    return stepped(state, gradient(edges.withColumn("p", F.col("p") * pull), state.select("t", "x", "y"), repel), momentum, rate)


def resting(at: DataFrame) -> DataFrame:
    """The state of positions at(t, x, y) that have not moved yet."""
    return at.select("t", "x", "y", *[F.lit(v).alias(c) for c, v in (("sx", 0.0), ("sy", 0.0), ("gx", 1.0), ("gy", 1.0))])


#: Rounds of a first layout, and of one that goes on.
ROUNDS, MORE_ROUNDS = 1000, 500


def fitted_in_rounds(points: DataFrame, perplexity: float = 30.0, rounds: int = ROUNDS, repel=repulsion_by_tree, sent: int = SENT) -> DataFrame:
    """(t, x, y) of points(t, v) as ``fitted``, with all rounds over all points.

    Neighbours are three times the perplexity's, their probabilities are found once. Up to ``sent`` points, rounds are those of
    ``rounds.laid_out``. Beyond that no task and not the driver holds a layout: each round is a few jobs, is written, and the one before deleted.
    ``repel``: ``repulsion_by_tree``, or ``repulsion`` over all pairs, always as jobs.
    """
    n = points.count()
    a, b = points.select(F.col("t").alias("i"), "v"), points.select(F.col("t").alias("j"), "v")
    near = keep(nearest(a, b, min(n - 1, int(3 * perplexity)), itself=False).select("i", "j", (F.col("d") * F.col("d")).alias("d")), "near")
    edges = keep(symmetrized(conditional(near, bandwidths(near, min(perplexity, (n - 1) / 3)).select("i", "beta"))), "edges")
    d = len(points.first()["v"])
    axes = main_axes(points.select("t", *[F.col("v")[k].alias(f"v{k}") for k in range(d)]), [f"v{k}" for k in range(d)])
    wide = with_stats(axes, F.stddev_pop("x").alias("_sd"))
    scale = F.when(F.col("_sd") > 0, 1e-4 / F.col("_sd")).otherwise(1e-4)
    start = wide.select("t", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))
    if n <= sent and repel is repulsion_by_tree:
        return laid_out(edges, start, lambda by, at: first_layout(by, at, rounds))
    state = keep(resting(start), "state")
    for k in range(rounds):
        early = k < rounds // 4
        before, state = state, keep(moved(edges, state, 12.0 if early else 1.0, 0.5 if early else 0.8, max(n / 12.0, 50.0), repel), "state")
        drop(before)
    return state.select("t", "x", "y")


#: Rows that still move when new ones come, and how many of the old ones hold the layout in place.
ACTIVE, ANCHORS = 1500, 500
#: The anchors' part in the forces.
BLEND = 0.5


def anchored(y: np.ndarray, at: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of points ``y`` against anchors ``at``: pulled by shares ``p`` (a row for each point), pushed by all, each by its weight."""
    way = y[:, None] - at[None]
    q = 1 / (1 + (way**2).sum(axis=2))
    push = q * weight
    return 4 * (((p - push / push.sum()) * q)[..., None] * way).sum(axis=1)


def shares_of(d: np.ndarray, perplexity: float, rounds: int = 60) -> np.ndarray:
    """Each row's shares of exp(-beta * d) over the columns, with the entropy of ``perplexity`` equal ones."""
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    target = math.log(min(perplexity, max((d.shape[1] - 1) / 3, 1.0)))
    near = d - d.min(axis=1, keepdims=True)
    for _ in range(rounds):
        w = np.exp(-near * beta[:, None])
        s = w.sum(axis=1)
        h = np.log(s) + beta * (near * w).sum(axis=1) / s
        low, high = np.where(h > target, beta, low), np.where(h > target, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    w = np.exp(-near * beta[:, None])
    return w / w.sum(axis=1, keepdims=True)


def kernel_anchored(v: np.ndarray, start: np.ndarray, anchors: np.ndarray, at: np.ndarray, weight: np.ndarray, perplexity: float = 30.0, rounds: int = 500, blend: float = BLEND, stale: int = 100) -> np.ndarray:
    """Positions of the rows of ``v`` from ``start``: their own forces and those of anchors, blended; ends after ``stale`` rounds without a better error."""
    n = len(v)
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, d.max() + 1e300 if n < 2 else np.inf)
    d = np.where(np.isfinite(d), d, d[np.isfinite(d)].max(initial=1.0) * 1e6)
    p = shares_of(d, perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    pc = shares_of(((v[:, None] - anchors[None]) ** 2).sum(axis=2), perplexity) * weight
    pc /= pc.sum()
    y, step, gains = start.astype(float), np.zeros_like(start, dtype=float), np.ones_like(start, dtype=float)
    best, best_error, since = y, np.inf, 0
    for k in range(rounds):
        way = y[:, None] - y[None]
        q = 1 / (1 + (way**2).sum(axis=2))
        np.fill_diagonal(q, 0)
        total = max(q.sum(), 1e-300)
        g = (1 - blend) * 4 * (((p - q / total) * q)[..., None] * way).sum(axis=1) + blend * anchored(y, at, pc, weight)
        if k % 10 == 0:
            error = float((p * np.log((p + 1e-12) / (q / total + 1e-12))).sum())
            best, best_error, since = (y, error, 0) if error < best_error else (best, best_error, since + 10)
            if since >= stale:
                return best
        gains = np.maximum(np.where(step * g < 0, gains + 0.2, gains * 0.8), 0.01)
        step = (0.5 if k < 250 else 0.8) * step - max(n / 12.0, 50.0) * gains * g
        y = np.floor((y + step) * 1e9) * 1e-9
    return y


def _begun(points: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of points(t, v, label) and the old ones' placed(t, x, y): the last ACTIVE old ones, all that move (t, v, x, y), and the anchors (v, x, y, w)."""
    old = points.join(placed.select("t", "x", "y"), "t")
    active = last_rows(old, ACTIVE)
    new = points.join(placed.select("t"), "t", "left_anti")
    near = nearest(new.select(F.col("t").alias("i"), "v"), active.select(F.col("t").alias("j"), "v"), 1).select("i", "j")
    begun = new.join(near, F.col("t") == F.col("i")).join(active.select(F.col("t").alias("j"), "x", "y"), "j").select("t", "v", "x", "y")
    n = active.count()
    few = min(n // 2, ANCHORS)
    sampled = active.orderBy(F.xxhash64(F.lit(42), "t"), "t").limit(few)
    one = (ANCHORS / (max(few, 1) / 2)) ** 0.13 if few < ANCHORS else 1.0
    d = len(points.first()["v"])
    mean = F.array(*[F.avg(F.col("v")[i]) for i in range(d)])
    labels = old.groupBy("label").agg(mean.alias("v"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sqrt(F.count(F.lit(1))).alias("w"))
    held = sampled.select("v", "x", "y", F.lit(one).alias("w")).union(labels.select("v", "x", "y", "w"))
    return active, active.select("t", "v", "x", "y").union(begun), held


def continued(points: DataFrame, placed: DataFrame, perplexity: float = 30.0, rounds: int = 500, blend: float = BLEND) -> DataFrame:
    """(t, x, y) of points(t, v, label), of which placed(t, x, y) has the old ones.

    New rows begin at their nearest old one among the last ACTIVE; these move with them, older ones stay. Sampled rows among
    them (half, ANCHORS at most) and the labels' means are anchors; a mean weighs the root of its rows. A task gets the rows that move and
    the anchors, not the whole layout; ``continued_in_rounds`` is for any number of new rows.
    """
    active, moving, held = _begun(points, placed)
    both = moving.withColumn("w", F.lit(None).cast("double")).union(held.select(F.lit(None).cast("long"), "v", "x", "y", "w"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["w"].isna().to_numpy()
        own, anchors = rows[mine].sort_values("t"), rows[~mine]
        y = kernel_anchored(np.stack(own["v"]), own[["x", "y"]].to_numpy(float), np.stack(anchors["v"]), anchors[["x", "y"]].to_numpy(float), anchors["w"].to_numpy(float), perplexity, rounds, blend)
        return pd.DataFrame({"t": own["t"].astype("int64"), "x": y[:, 0], "y": y[:, 1]})

    moved = both.groupBy(F.lit(1).alias("_all")).applyInPandas(run, "t long, x double, y double")
    return placed.select("t", "x", "y").join(active.select("t"), "t", "left_anti").union(moved)


def probabilities(rows: DataFrame, perplexity: float, k: int) -> DataFrame:
    """(i, j, p): symmetric probabilities of each of rows(t, v) and its k nearest others."""
    a, b = rows.select(F.col("t").alias("i"), "v"), rows.select(F.col("t").alias("j"), "v")
    near = keep(nearest(a, b, k, itself=False).select("i", "j", (F.col("d") * F.col("d")).alias("d")), "near")
    return keep(symmetrized(conditional(near, bandwidths(near, perplexity).select("i", "beta"))), "edges")


def anchor_edges(moving: DataFrame, held: DataFrame, perplexity: float, k: int) -> DataFrame:
    """(i, j, p, xj, yj): shares of each of moving(t, v) and its k nearest anchors held(a, v, x, y, w), times the anchors' weights; all together 1."""
    near = keep(nearest(moving.select(F.col("t").alias("i"), "v"), held.select(F.col("a").alias("j"), "v"), k).select("i", "j", (F.col("d") * F.col("d")).alias("d")), "near")
    return weighed(conditional(near, bandwidths(near, perplexity).select("i", "beta")), held)


def weighed(p: DataFrame, held: DataFrame) -> DataFrame:
    """(i, j, p, xj, yj): shares p(i, j, p) of anchors times their weights, over the sum of all."""
    found = p.join(F.broadcast(held.select(F.col("a").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "w")), "j").withColumn("p", F.col("p") * F.col("w"))
    found = keep(found.select("i", "j", "p", "xj", "yj"), "weighed")
    return keep(with_stats(found, F.sum("p").alias("_all")).withColumn("p", F.col("p") / F.col("_all")).drop("_all"), "anchor_edges")


def anchored_gradient(edges: DataFrame, held: np.ndarray, at: DataFrame) -> DataFrame:
    """(i, gx, gy) at positions at(t, x, y): pulled along ``edges`` of ``anchor_edges``, pushed by all anchors (rows of x, y, weight), as ``anchored`` without its factor of 4.

    Anchors are ANCHORS rows and one a label, so they are sent to all tasks; the pushes' sum over all points is one number of a job.
    """

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
            step = max(1, (1 << 20) // max(1, len(held)))
            for k in range(0, len(y), step):
                way = y[k : k + step, None] - held[None, :, :2]
                q = 1 / (1 + (way**2).sum(axis=2))
                f = ((q * q * held[:, 2])[..., None] * way).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("t").slice(k, step), pa.array((q * held[:, 2]).sum(axis=1)), pa.array(f[:, 0]), pa.array(f[:, 1])], ["i", "z", "rx", "ry"])

    away = keep(at.select("t", "x", "y").mapInArrow(push, "i long, z double, rx double, ry double"), "pushes")
    way = edges.join(at.toDF("i", "xi", "yi"), "i").withColumn("dx", F.col("xi") - F.col("xj")).withColumn("dy", F.col("yi") - F.col("yj"))
    f = F.col("p") / (1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    pull = way.groupBy("i").agg(F.sum(f * F.col("dx")).alias("fx"), F.sum(f * F.col("dy")).alias("fy"))
    both = with_stats(away, F.sum("z").alias("_z")).join(pull, "i", "left")
    return both.select("i", *[(F.coalesce(f"f{a}", F.lit(0.0)) - F.col(f"r{a}") / F.col("_z")).alias(f"g{a}") for a in "xy"])


def gradient_of_all_anchors(rows: DataFrame, held: DataFrame, beta: float) -> DataFrame:
    """(i, gx, gy) as ``anchored_gradient`` with every anchor of held(a, v, x, y, w) tied to every one of rows(t, v, x, y), by shares of exp(-beta * d * d).

    Both scales, a row's sum of shares and the pushes' sum over all, can be taken out of the sums; so each pair of blocks gives
    a few sums of a row, and no pair of a row and an anchor leaves its task.
    """
    names = ("s", "p", "z", "fx", "fy", "rx", "ry")

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.float64()) for _ in names]], names=["i", *names])
        v, anchors, out = matrix(a), matrix(b), np.zeros((len(names), a.num_rows))
        x, y, xa, ya, w = (t.column(c).to_numpy() for t, c in ((a, "x"), (a, "y"), (b, "xa"), (b, "ya"), (b, "w")))
        for k in range(0, len(v), 256):
            mine = slice(k, k + 256)
            for m in range(0, len(anchors), BLOCK):
                other = slice(m, m + BLOCK)
                d = distances(v[mine], anchors[other])
                p = np.exp(-beta * (d * d))
                dx, dy = x[mine, None] - xa[None, other], y[mine, None] - ya[None, other]
                q = 1 / (1 + dx * dx + dy * dy)
                out[0, mine] += p.sum(axis=1)
                p *= w[other]
                out[1, mine] += p.sum(axis=1)
                p *= q
                push = q * w[other]
                out[2, mine] += push.sum(axis=1)
                push *= q
                for n, (share, way) in enumerate(((p, dx), (p, dy), (push, dx), (push, dy)), 3):
                    out[n, mine] += np.einsum("nm,nm->n", share, way)
        return pa.table([a.column("i"), *[pa.array(o) for o in out]], names=["i", *names])

    left = rows.select(F.col("t").cast("long").alias("i"), "v", "x", "y")
    right = held.select(F.col("a").cast("long").alias("j"), "v", F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("w").cast("double").alias("w"))
    parts = dealt(left, right, None, "i", "j").applyInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names))
    sums = keep(parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]), "anchors")
    both = with_stats(sums, F.sum(F.col("p") / F.col("s")).alias("_p"), F.sum("z").alias("_z"))
    return both.select("i", *[(F.col(f"f{a}") / (F.col("s") * F.col("_p")) - F.col(f"r{a}") / F.col("_z")).alias(f"g{a}") for a in "xy"])


def continued_in_rounds(points: DataFrame, placed: DataFrame, perplexity: float = 30.0, rounds: int = MORE_ROUNDS, blend: float = BLEND, stale: int = 100, k: int = 0, repel=repulsion_by_tree, sent: int = SENT) -> DataFrame:
    """``continued`` with each round as a job or jobs over the rows that move, however many: forces along edges to the k nearest (three times
    the perplexity if 0) rows and anchors, repulsion by the tree, pushes of all anchors; every tenth round the error, until it has not improved for ``stale`` rounds.

    ``repel`` and ``sent`` as for ``fitted_in_rounds``.
    """
    active, moving, held = _begun(points, placed)
    moving = keep(moving, "moving")
    held = held.orderBy("w", "x", "y").toPandas()  # ANCHORS rows and one a label
    anchors = points.sparkSession.createDataFrame([(a, [float(z) for z in r.v], float(r.x), float(r.y), float(r.w)) for a, r in enumerate(held.itertuples())], "a long, v array<double>, x double, y double, w double")
    n, k = moving.count(), k or int(3 * perplexity)
    of = lambda m: min(perplexity, max((m - 1) / 3, 1.0))
    edges = probabilities(moving.select("t", "v"), of(n), min(k, max(n - 1, 1)))
    ties = anchor_edges(moving.select("t", "v"), anchors, of(len(held)), min(k, len(held)))
    fixed = held[["x", "y", "w"]].to_numpy(float)
    rest = placed.select("t", "x", "y").join(active.select("t"), "t", "left_anti")
    if n <= sent and repel is repulsion_by_tree:
        return rest.union(laid_out(edges, moving, lambda by, at: next_layout(by, at, fixed, rounds, blend, stale), ties))
    state = keep(resting(moving), "state")
    best, least, since = state, np.inf, 0
    for turn in range(rounds):
        at = state.select("t", "x", "y")
        if turn % 10 == 0:
            error = kl_error(edges, at, repel=repel).first()["error"]
            if error < least:
                if best is not state:
                    drop(best)
                best, least, since = state, error, 0
            else:
                since += 10
            if since >= stale:
                break
        own, ties_g = gradient(edges, at, repel), anchored_gradient(ties, fixed, at).toDF("i", "ax", "ay")
        g = own.join(ties_g, "i").select("i", *[((1 - blend) * F.col(f"g{a}") + blend * F.col(f"a{a}")).alias(f"g{a}") for a in "xy"])
        before, state = state, keep(stepped(state, g, 0.5 if turn < 250 else 0.8, max(n / 12.0, 50.0)), "state")
        if before is not best:
            drop(before)
    last = best if since >= stale else state
    return rest.union(last.select("t", "x", "y"))


def main_axes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(t, x, y): rows on the two main axes of some columns, from one pass of sums over all rows; an axis's largest part is positive."""
    v = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    wide = rows.select("t", v.alias("v"))
    found = moments(wide.select(F.lit(0).alias("label"), "v")).first()
    d = len(columns)
    axes = np.linalg.eigh(np.reshape(found["s"], (d, d)))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    along = lambda k: sum((F.lit(float(axes[i, k])) * (F.col("v")[i] - float(found["mu"][i])) for i in range(d)), F.lit(0.0))
    return wide.select("t", along(0).alias("x"), along(1).alias("y"))


# What the repulsion of a far group of points comes to: sums by cells of grids of several sizes.


def cells(at: DataFrame, levels: int) -> DataFrame:
    """(level, gx, gy, n, x, y) of positions at(t, x, y): how many points each cell of each grid has, and their mean.

    The bounding square is halved ``levels`` times, as a quad-tree's levels.
    """
    ends = at.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_side"))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    wide = at.join(F.broadcast(ends)).select("x", "y", "_x0", "_y0", "_side", every)
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("_side") * F.pow(F.lit(2.0), "level")), F.pow(F.lit(2.0), "level") - 1).cast("long")
    found = wide.groupBy("level", cell("x", "_x0").alias("gx"), cell("y", "_y0").alias("gy"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def repulsion_by_cells(at: DataFrame, levels: int = 7, theta: float = 0.3, most_cells: int = 1 << 20) -> DataFrame:
    """(i, q, fx, fy) as ``repulsion``, where a cell that is small as seen from a point (side over distance below ``theta``) counts as its points at their mean.

    Cells of all levels go to the tasks, whose number is checked: there are 4 ** levels at most on the last one. What
    is near and in one cell of the last level is summed by cells of that level, with the point's own share taken out.
    """
    found = cells(at, levels)
    ends = at.agg(F.min("x"), F.min("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    rows = found.collect() if sum(4**k for k in range(levels + 1)) <= most_cells or found.count() <= most_cells else None
    if rows is None:
        raise ValueError("too many cells for the tasks: fewer levels are needed")
    side = float(ends[2]) or 1.0
    grids: list[dict] = [{} for _ in range(levels + 1)]
    for r in rows:
        grids[r["level"]][(r["gx"], r["gy"])] = (float(r["n"]), r["x"], r["y"])
    keys = [np.array(sorted(g), np.int64).reshape(-1, 2) for g in grids]
    values = [np.array([g[tuple(k)] for k in ks.tolist()]).reshape(-1, 3) for g, ks in zip(grids, keys, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = frame[["x", "y"]].to_numpy(float)
            q, f = np.zeros(len(p)), np.zeros((len(p), 2))
            near_p, near_c = np.repeat(np.arange(len(p)), len(keys[0])), np.tile(np.arange(len(keys[0])), len(p))
            for level in range(levels + 1):
                n, mean = values[level][near_c, 0], values[level][near_c, 1:]
                way = p[near_p] - mean
                far2 = (way**2).sum(axis=1)
                done = (side / 2**level) ** 2 < theta**2 * far2
                if level == levels:
                    done[:] = True
                    own = np.minimum(np.floor((p[near_p] - [float(ends[0]), float(ends[1])]) / side * 2**level), 2**level - 1).astype(np.int64)
                    inside = (own == keys[level][near_c]).all(axis=1)
                    rest = np.where(inside, n - 1, n)
                    mean = np.where((inside & (n > 1))[:, None], (mean * n[:, None] - p[near_p]) / np.maximum(n - 1, 1)[:, None], mean)
                    way, n = p[near_p] - mean, rest
                    far2 = (way**2).sum(axis=1)
                k = 1 / (1 + far2[done])
                np.add.at(q, near_p[done], n[done] * k)
                np.add.at(f, near_p[done], (n[done] * k * k)[:, None] * way[done])
                if level < levels:
                    open_p, open_k = near_p[~done], keys[level][near_c[~done]]
                    place = {tuple(x): i for i, x in enumerate(keys[level + 1].tolist())}
                    parts = [(open_p, np.array([place.get((2 * x + a, 2 * y + b), -1) for x, y in open_k.tolist()], np.int64)) for a in (0, 1) for b in (0, 1)]
                    near_p = np.concatenate([x[c >= 0] for x, c in parts])
                    near_c = np.concatenate([c[c >= 0] for _, c in parts])
            yield pd.DataFrame({"i": frame["t"], "q": q, "fx": f[:, 0], "fy": f[:, 1]})

    return at.select("t", "x", "y").mapInPandas(run, "i long, q double, fx double, fy double")


def principal(v: np.ndarray) -> np.ndarray:
    """The two main axes' coordinates, each axis turned so that its largest part is positive."""
    centred = v - v.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return centred @ axes


def kmeans(points: DataFrame, k: int, rounds: int) -> DataFrame:
    """(t, cluster) of points(t, x, y): clusters begin as equal stretches of t; empty ones vanish.

    Each round moves one row a cluster; points are compared with all centres in their row.
    """
    wide = with_stats(points, F.count(F.lit(1)).alias("_n"), F.min("t").alias("_low"))
    now = wide.select("t", "x", "y", F.floor((F.col("t") - F.col("_low")) * k / F.col("_n")).cast("int").alias("cluster"))
    for _ in range(rounds):
        centres = now.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "cx", "cy"))).alias("_c"))
        far = lambda c: (F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2
        best = F.array_min(F.transform("_c", lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster"))))
        now = points.join(F.broadcast(packed)).select("t", "x", "y", best["cluster"].alias("cluster"))
    return now.select("t", "cluster")
