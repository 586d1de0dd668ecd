"""Exact nearest neighbours that rule out by the triangle inequality what can't be near.

Rows of the right side belong to the cell of their nearest pivot (means of a sample), and within it to one of RINGS
rings of equally many rows by their distance from the pivot. From a row's distances to the pivots alone follow, for
each ring, a least and a greatest distance of its rows. A row first visits the nearest rings, up to a few times k rows;
the k-th distance found there is a limit, and in a second round it visits just the rings whose least distance is within
it. What is sent to all tasks are PIVOTS points and PIVOTS * RINGS pairs of distances, whatever the number of rows; rings
with more than BLOCK rows are dealt into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from .pairs import BLOCK, _best, matrix

PIVOTS, RINGS, SAMPLE = 128, 16, 16_384
#: Rows of a ring at least, on average: fewer pivots are taken for small tables.
LEAST = 8
#: How many times k rows the first round looks at.
FIRST = 4


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0))


def means(points: np.ndarray, n: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """``n`` points at most, in the middle of parts of ``points``."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:n]]
    for _ in range(turns):
        own = distances(points, centres).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, k], minlength=len(centres)) for k in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass
class Rings:
    """Pivots, and by ring its pivot, the least and greatest distance from it, and its number of rows."""

    pivots: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distances of each of ``x`` from each ring's rows, widened by the error of sums."""
        d = distances(x, self.pivots)
        own = d.argmin(axis=1)
        gap = distances(self.pivots, self.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            # A cell's rows are on its pivot's side of the plane between it and the row's own pivot.
            plane = np.where(gap > 0, (d * d - (d.min(axis=1) ** 2)[:, None]) / (2 * gap), 0.0)
        far = d[:, self.of]
        slack = 1e-6 * (1 + far)
        return np.maximum(np.maximum(far - self.high, self.low - far), plane[:, self.of]) - slack, far + self.high + slack

    def limit(self, high: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row surely has k others."""
        order = high.argsort(axis=1)
        enough = np.cumsum(self.rows[order], axis=1) > k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), -1)
        return np.where(at < 0, np.inf, high[np.arange(len(high)), order[np.arange(len(high)), at]])

    def first(self, low: np.ndarray, k: int) -> np.ndarray:
        """Marks the nearest rings of each row, up to FIRST * (k + 1) rows."""
        order = low.argsort(axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        marks = np.zeros(low.shape, bool)
        np.put_along_axis(marks, order, before < FIRST * (k + 1), axis=1)
        return marks


def ringed(right: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, Rings]:
    """``right(id, v)`` as (ring, block, id, v), written once, and the rings."""
    n = right.count()
    drawn = right.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 1.5 * sample / max(n, 1)) * (1 << 20)) + 1).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    points = means(matrix(drawn), min(pivots, max(1, n // (LEAST * RINGS)))) if drawn.num_rows else np.zeros((0, 1))

    def place(batches):
        for batch in batches:
            d = distances(matrix(pa.table(batch)), points) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1, initial=np.inf)), batch.column("id"), batch.column("v")], ["cell", "far", "id", "v"])

    placed = keep(right.mapInArrow(place, "cell int, far double, id long, v array<double>"), "cells")
    edges = {r.cell: r.edges for r in placed.groupBy("cell").agg(F.percentile_approx("far", [k / RINGS for k in range(1, RINGS)], 1000).alias("edges")).collect()}
    table = right.sparkSession.createDataFrame(sorted(edges.items()), "cell int, edges array<double>")
    ring = F.col("cell") * RINGS + F.size(F.filter("edges", lambda x: x < F.col("far")))
    in_rings = placed.join(F.broadcast(table), "cell").select(ring.alias("ring"), "far", "id", "v")
    stats = sorted(in_rings.groupBy("ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.ring)
    numbers = right.sparkSession.createDataFrame([(r.ring, k, -(-r.n // BLOCK)) for k, r in enumerate(stats)], "ring int, number int, blocks int")
    found = in_rings.join(F.broadcast(numbers), "ring").select(F.col("number").alias("ring"), F.pmod(F.hash("id"), "blocks").alias("block"), "id", "v")
    column = lambda name, kind: np.array([r[name] for r in stats], kind)
    return keep(found, "rings"), Rings(points, column("ring", int) // RINGS, column("low", float), column("high", float), column("n", int))


def _visits(left: DataFrame, rings: Rings, k: int) -> DataFrame:
    """(ring, id, v) of what each row of ``left(id, v, limit)`` visits: without a limit the nearest rings, with one those within it but the nearest."""

    def run(batches):
        step = max(1, (1 << 21) // max(1, len(rings.of)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                low, high = rings.bounds(matrix(pa.table(part)))
                marks = rings.first(low, k)
                limit = part.column("limit").to_numpy(zero_copy_only=False).astype(float)
                if not np.isnan(limit).all():
                    marks = ~marks & (low <= np.fmin(limit, rings.limit(high, k))[:, None])
                row, ring = np.nonzero(marks)
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ring, pa.int32()), part.column("id").take(again), part.column("v").take(again)], ["ring", "id", "v"])

    return left.mapInArrow(run, "ring int, id long, v array<double>")


def _met(visits: DataFrame, right: DataFrame, k: int, itself: bool) -> DataFrame:
    """(i, j, d): each visiting row's k best of each block of the ring."""
    key = ["ring", "block", "_part"]
    sizes = visits.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    per = right.groupBy("ring").agg((F.max("block") + 1).alias("blocks"))
    mine = visits.join(sizes, "ring").join(per, "ring").withColumn("_part", F.pmod(F.hash("id"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    theirs = right.join(sizes.select(F.col("ring").alias("ring"), F.col("parts").alias("parts")), "ring").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        y = y.sort_by("id")
        i, j = x.column("id").to_numpy(), y.column("id").to_numpy()
        r, c, d = _best(matrix(x), matrix(y), k, None if itself else (i, j))
        return pa.table([pa.array(i[r]), pa.array(j[c]), pa.array(d)], schema=schema)

    return mine.select(*key, "id", "v").groupBy(*key).cogroup(theirs.select(*key, "id", "v").groupBy(*key)).applyInArrow(run, "i long, j long, d double")


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)


def search(left: DataFrame, right: DataFrame, k: int, itself: bool = True, pivots: int = PIVOTS) -> tuple[DataFrame, float]:
    """``nearest_pruned``, and the share of all pairs of a row and a ring that were looked at."""
    left = keep(left.select(F.col("i").cast("long").alias("id"), "v"), "left")
    rows, rings = ringed(right.select(F.col("j").cast("long").alias("id"), "v"), pivots)
    if not len(rings.of):
        return left.sparkSession.createDataFrame([], "i long, j long, d double, rank int"), 0.0
    first = keep(_visits(left.withColumn("limit", F.lit(None).cast("double")), rings, k), "visits")
    near = keep(_top(_met(first, rows, k, itself), k), "near")
    limits = near.where(F.col("rank") == k).select(F.col("i").alias("id"), F.col("d").alias("limit"))
    second = keep(_visits(left.join(limits, "id", "left").select("id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit")), rings, k), "visits")
    found = _top(near.drop("rank").unionByName(_met(second, rows, k, itself)), k)
    return found, (first.count() + second.count()) / max(left.count() * len(rings.of), 1)


def nearest_pruned(left: DataFrame, right: DataFrame, k: int, itself: bool = True, pivots: int = PIVOTS) -> DataFrame:
    """(i, j, d, rank): the k rows of ``right(j, v)`` nearest to each of ``left(i, v)``, ties by j; exact, as ``pairs.nearest``.

    Where rows lie in clusters or on few axes most rings are never looked at; where all distances are alike, all are.
    """
    return search(left, right, k, itself, pivots)[0]
