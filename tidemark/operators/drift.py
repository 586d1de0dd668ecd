"""Drift scores: label-conditioned energy distance of windows or chunks of a stream to their nearest training rows.

For the rows W of a window that have one label, T is the distinct union of their k nearest training rows of that label.
With A, B, C the sums of distances W-T, W-W and T-T, the label's drift is |W| * (1 - (B/|W|^2 + C/|T|^2) / (2A/(|W||T|))), |W|
where T is empty, 0 where A is below a guard. The window's drift is the labels' sum over its length.

Rows are (t, v, label), with v an array of any number of axes, or (t, x, label) on one axis. Neighbours come from
``pairs.nearest_of_label``, whatever the number of training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep
from .ordered import in_blocks, ranked
from .pairs import distance_block, energy, matrix, nearest_of_label, pair_sums, vectors

GUARD = 1e-4


def _drift(w, t, a, b, c, guarded):
    """A label's drift from its counts and sums."""
    mean_a = a / (w * t)
    return F.when((w == 0) | (t == 0), w).when(guarded < GUARD, 0.0).otherwise(w * energy(mean_a, b / (w * w), c / (t * t)))


def _sums_on_an_axis(members: DataFrame, keys: list[str]) -> DataFrame:
    """``pair_sums`` of members(keys, side, x) in one sort: x at place r (from 1) of n counts 2r - n - 1 times, and A is half of what B and C leave of all."""
    sides = {"_rw": F.when(F.col("side") == 0, 1).otherwise(0), "_rt": F.when(F.col("side") == 1, 1).otherwise(0)}
    members = keep(members.select(*keys, "side", "x"), "members")  # ranges are drawn from a first pass over them
    placed = ranked(members, keys, ["x", "side"], sides)
    x, rw, rt = F.col("x"), F.col("_rw"), F.col("_rt")
    of = lambda side, value: F.sum(F.when(F.col("side") == side, value).otherwise(0.0))
    sums = placed.groupBy(*keys).agg(
        F.sum((F.col("side") == 0).cast("double")).alias("w"), F.sum((F.col("side") == 1).cast("double")).alias("t"), of(0, x).alias("xw"), of(1, x).alias("xt"),
        of(0, (2 * rw - 1) * x).alias("bw"), of(1, (2 * rt - 1) * x).alias("bt"), F.sum((2 * (rw + rt) - 1) * x).alias("both"),
    )
    w, t = F.col("w"), F.col("t")
    b, c, every = 2 * (F.col("bw") - w * F.col("xw")), 2 * (F.col("bt") - t * F.col("xt")), 2 * (F.col("both") - (w + t) * (F.col("xw") + F.col("xt")))
    return sums.select(*keys, ((every - b - c) / 2).alias("a"), b.alias("b"), c.alias("c"), "w", "t")


def _sums(members: DataFrame, keys: list[str]) -> DataFrame:
    return _sums_on_an_axis(members, keys) if "x" in members.columns else pair_sums(members, keys)


def of_chunks(chunks: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """(chunk_id, drift) of ``chunks(chunk_id, t, v or x, label)``; training rows as (t, v or x, label). The guard is on the mean of A.

    On one axis sums over pairs come from sorted rows, so no pairs are made; else from blocks of each chunk and label.
    """
    value, keys = ("x" if "x" in chunks.columns else "v"), ["chunk_id", "label"]
    near = nearest_of_label(chunks.select("t", value, "label").dropDuplicates(["t"]), trained, k)
    own = trained.select(F.col("t").alias("j"), value)
    used = chunks.select(*keys, F.col("t").alias("i")).join(near.select("i", "j"), "i").select(*keys, "j").distinct().join(own, "j")
    members = chunks.select(*keys, F.lit(0).alias("side"), F.col("t").alias("id"), value).union(used.select(*keys, F.lit(1), "j", value))
    w, t, a, b, c = (F.col(x) for x in "wtabc")
    score = _drift(w, t, a, b, c, a / (w * t))
    return _sums(members, keys).select("chunk_id", "w", score.alias("d")).groupBy("chunk_id").agg((F.sum("d") / F.sum("w")).alias("drift"))


def between(rows: DataFrame, reference: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, by, drift): energy distance of each group of ``rows(keys, by, t, v or x)`` to ``reference(by, t, v or x)`` of its ``by``.

    The reference is copied for each of the keys, of which there are few.
    """
    value, every = ("x" if "x" in rows.columns else "v"), [*keys, by]
    groups = rows.select(*every).distinct()
    members = rows.select(*every, F.lit(0).alias("side"), F.col("t").alias("id"), value).union(groups.join(reference, by).select(*every, F.lit(1), "t", value))
    w, t, a, b, c = (F.col(x) for x in "wtabc")
    return _sums(members, every).where((w > 0) & (t > 0)).select(*every, energy(a / (w * t), b / (w * w), c / (t * t)).alias("drift"))


#: Rows of the order that are scored together, if a window is not longer.
BLOCK = 1024


def _sums_over(values: np.ndarray, width: int) -> np.ndarray:
    """Of each row and the ``width`` - 1 before it."""
    total = np.cumsum(values, axis=0, dtype=float)
    out = total.copy()
    out[width:] -= total[:-width]
    return out


def _scores(x: np.ndarray, here: np.ndarray, xs: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each window, its drift of one label: ``here`` marks the label's rows, ``near`` which of the training rows ``xs`` each has as neighbours."""
    w = np.round(_sums_over(here.astype(float), width))
    if not len(xs):
        return w
    d = np.zeros(near.shape)
    d[here] = distance_block(x[here], xs)
    active = np.round(_sums_over(near, width)) > 0
    t = active.sum(axis=1)
    a = (_sums_over(d, width) * active).sum(axis=1)
    c = ((active.astype(float) @ distance_block(xs, xs)) * active).sum(axis=1)
    b = np.zeros(len(x))
    for lag in range(1, min(width, len(x))):
        both = np.zeros(len(x))
        pair = here[lag:] & here[:-lag]
        both[lag:][pair] = np.sqrt(((x[lag:][pair] - x[:-lag][pair]) ** 2).sum(axis=1))
        b += 2 * _sums_over(both, width - lag)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = w * (1 - (b / (w * w) + c / (t * t)) / (2 * a / (w * t)))
    return np.where((w == 0) | (t == 0), w, np.where(a < GUARD, 0.0, score))


def sliding(rows: DataFrame, trained: DataFrame, width: int, k: int, block: int = 0) -> DataFrame:
    """(t, drift) of the window of ``width`` rows that ends at t, from the first whole one on. The guard is on the sum of A.

    Rows are dealt into blocks of the order, each with the ``width`` - 1 rows before it and the neighbours of its rows,
    so a task holds a block's rows and neighbours, however many training rows there are.
    """
    near = nearest_of_label(rows, trained, k)
    rows, trained = vectors(rows).select("t", "v", "label"), vectors(trained).select("t", "v", "label")
    uses = near.select(F.col("i").alias("t"), "label", "j").join(trained.select(F.col("t").alias("j"), "v"), "j").select("t", "label", "j", "v")
    size = max(width, block or BLOCK)
    first = rows.agg(F.min("t").alias("_first"))

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        schema = pa.schema([("t", pa.int64()), ("drift", pa.float64())])
        if not mine.num_rows:
            return schema.empty_table()
        t = mine.column("t").to_numpy()
        low = int(t.min())
        at, n = t - low, int(t.max()) - low + 1
        x = np.zeros((n, matrix(mine).shape[1]))
        x[at] = matrix(mine)
        labels, used = np.array(mine.column("label").to_pylist(), object), np.array(theirs.column("label").to_pylist(), object)
        when, js, vs = theirs.column("t").to_numpy(), theirs.column("j").to_numpy(), matrix(theirs)
        total = np.zeros(n)
        for label in set(labels.tolist()):
            here = np.zeros(n, bool)
            here[at[labels == label]] = True
            own = np.flatnonzero(used == label)
            _, where, which = np.unique(js[own], return_index=True, return_inverse=True)
            near = np.zeros((n, len(where)))
            near[when[own] - low, which] = 1.0
            total += _scores(x, here, vs[own][where] if len(own) else np.zeros((0, x.shape[1])), near, width)
        ours = mine.column("_own").to_numpy(zero_copy_only=False) & (t >= mine.column("_first").to_numpy() + width - 1)
        return pa.table([pa.array(t[ours]), pa.array(total[at[ours]] / width)], schema=schema)

    left = in_blocks(rows, width - 1, 0, size=size).join(F.broadcast(first))
    right = in_blocks(uses, width - 1, 0, size=size).select(*[F.col(c).alias(c) for c in ("t", "label", "j", "v", "_block")])
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(run, "t long, drift double")


def adjacent(rows: DataFrame, width: int, block: int = 0) -> DataFrame:
    """(t, drift): energy distance of the ``width`` rows before t and the ``width`` rows from t on, whatever their labels.

    A block of the order makes the distances of its rows (with ``width`` more on either side); sums over stretches of them
    are differences of running sums along both sides.
    """
    rows = vectors(rows).select("t", "v")
    bounds = rows.agg(F.min("t").alias("_low"), F.max("t").alias("_high"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        order = np.argsort(t)
        x, t = matrix(table)[order], t[order]
        total = np.zeros((len(t) + 1, len(t) + 1))
        total[1:, 1:] = np.cumsum(np.cumsum(distance_block(x, x), axis=0), axis=1)
        low, high = (table.column(c).to_numpy()[0] for c in ("_low", "_high"))
        at = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False)[order] & (t >= low + width) & (t + width - 1 <= high))
        area = lambda i, j: total[i + width, j + width] - total[i, j + width] - total[i + width, j] + total[i, j]
        a, b, c = area(at - width, at), area(at - width, at - width), area(at, at)
        with np.errstate(divide="ignore", invalid="ignore"):
            drift = np.where(a < GUARD, 0.0, 1 - (b + c) / (2 * a))
        return pa.table({"t": pa.array(t[at]), "drift": pa.array(drift, pa.float64())})

    blocks = in_blocks(rows, width, width - 1, size=max(width, block or BLOCK)).join(F.broadcast(bounds))
    return blocks.groupBy("_block").applyInArrow(run, "t long, drift double")
