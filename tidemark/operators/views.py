"""Aggregates behind the linked views: grids of density, centroids, flags on an axis, provenance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import drop, keep
from .prepare import with_stats


def grid(points: DataFrame, size: float) -> DataFrame:
    """(gx, gy, n, ids): points of each square cell that has any."""
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    return points.groupBy(cell("cx").alias("gx"), cell("cy").alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t")).alias("ids"))


def offsets(reach: int, fall: float) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of cells that are ``reach`` steps off at most and weigh something."""
    out = [(dx, dy, 1.0 - fall * (abs(dx) + abs(dy))) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if abs(dx) + abs(dy) <= reach]
    return [x for x in out if x[2] > 0]


def smoothed(cells: DataFrame, reach: int, fall: float, most: float, value: Column | None = None) -> DataFrame:
    """(gx, gy, density): each cell's count goes to the cells around it, less with each step; ``most`` is the top.

    Each cell of points is copied to its neighbours and summed there: one shuffle of cells, no join.
    """
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in offsets(reach, fall)])
    spread = cells.select("gx", "gy", (F.col("n") if value is None else value).alias("n"), F.explode(around).alias("o"))
    spread = spread.select((F.col("gx") + F.col("o")["dx"]).alias("gx"), (F.col("gy") + F.col("o")["dy"]).alias("gy"), (F.col("n") * F.col("o")["w"]).alias("d"))
    ends = cells.agg(F.max("gx").alias("_x"), F.max("gy").alias("_y"))
    inside = spread.join(F.broadcast(ends)).where("gx >= 0 and gy >= 0 and gx <= _x and gy <= _y")
    return inside.groupBy("gx", "gy").agg(F.least(F.sum("d"), F.lit(most)).alias("density"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(gx, gy, value, opacity): new less old density, and (|value| / largest)**1.25."""
    both = old.withColumnRenamed("density", "_old").join(new.withColumnRenamed("density", "_new"), ["gx", "gy"], "full").fillna(0.0, ["_old", "_new"])
    value = both.select("gx", "gy", (F.col("_new") - F.col("_old")).alias("value"))
    wide = with_stats(value, F.max(F.abs("value")).alias("_top"))
    return wide.select("gx", "gy", "value", F.when(F.col("_top") > 0, F.pow(F.abs("value") / F.col("_top"), 1.25)).otherwise(0.0).alias("opacity"))


def axis_flags(rows: DataFrame, slices: int) -> DataFrame:
    """(slice, n, selected, shown, status) of rows(t, selected, shown) along an axis cut into equal slices.

    status is 1 where some rows are selected, 3 where nearly all are, else 0.
    """
    wide = with_stats(rows, F.min("t").alias("_low"), (F.max("t") + 1).alias("_high"))
    at = F.floor((F.col("t") - F.col("_low")) * slices / (F.col("_high") - F.col("_low"))).cast("int")
    counts = wide.groupBy(at.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("selected").cast("long")).alias("selected"), F.sum(F.col("shown").cast("long")).alias("shown"))
    ratio = F.col("selected") / (F.col("n") + 1e-5)
    return counts.withColumn("status", F.when(ratio > 0.95, 3).when(F.col("selected") > 0, 1).otherwise(0))


def polygon_area(corners: Column) -> Column:
    """Of an array of (x, y) structs: a fan of triangles from the first corner, each by its three sides."""
    side = lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)

    def triangle(i: Column) -> Column:
        p, q, r = corners[0], corners[i], corners[i + 1]
        a, b, c = side(p, q), side(q, r), side(r, p)
        s = (a + b + c) / 2
        return F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))

    return F.aggregate(F.sequence(F.lit(1), F.size(corners) - 2), F.lit(0.0), lambda total, i: total + triangle(i))


def sampled(rows: DataFrame, n: int, seed: int = 42, t: str = "t") -> DataFrame:
    """``n`` rows by the order of a hash of their numbers: the points of a haze."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(t).cast("string"), F.lit(str(seed))).cast("binary")), t).limit(n)


def kernel_density(points: DataFrame, size: float, bandwidth: float, reach: int) -> DataFrame:
    """(gx, gy, density): Gaussian kernels of the points at the middles of square cells, ``reach`` cells around each point's own.

    A point is copied to the cells that it reaches and summed there; no join.
    """
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
    own = lambda c: F.floor(F.col(c) / size).cast("int")
    spread = points.select("cx", "cy", own("cx").alias("_x"), own("cy").alias("_y"), F.inline(around))
    spread = spread.select("cx", "cy", (F.col("_x") + F.col("dx")).alias("gx"), (F.col("_y") + F.col("dy")).alias("gy"))
    away = lambda c, g: F.pow(F.col(c) - (F.col(g) + 0.5) * size, 2)
    kernel = F.exp(-(away("cx", "gx") + away("cy", "gy")) / (2 * bandwidth * bandwidth)) / (2 * math.pi * bandwidth * bandwidth)
    return spread.groupBy("gx", "gy").agg(F.sum(kernel).alias("density"))


def intersections(polygons: DataFrame, size: float) -> DataFrame:
    """(i, j, area) of the pairs of convex polygons (i, corners) that share some, with corners (x, y) in turn.

    Polygons meet by the square cells of ``size`` that their bounding boxes reach, in the first one that two share, so only
    near ones are compared; one is cut by the other's edges.
    """
    low, high = (lambda c, f=f: f(F.transform("corners", lambda p: p[c])) for f in (F.array_min, F.array_max))
    cells = lambda c: F.sequence(F.floor(low(c) / size), F.floor(high(c) / size))
    wide = polygons.select("i", "corners", low("x").alias("x0"), low("y").alias("y0"), F.explode(cells("x")).alias("gx"), cells("y").alias("_y")).select("i", "corners", "x0", "y0", "gx", F.explode("_y").alias("gy"))
    other = wide.toDF("j", "corners2", "x02", "y02", "gx2", "gy2")
    met = wide.join(other, (F.col("gx") == F.col("gx2")) & (F.col("gy") == F.col("gy2")) & (F.col("i") < F.col("j")))
    first = (F.col("gx") == F.floor(F.greatest("x0", "x02") / size)) & (F.col("gy") == F.floor(F.greatest("y0", "y02") / size))

    @F.pandas_udf("double")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cut_area([(p["x"], p["y"]) for p in x], [(p["x"], p["y"]) for p in y]) for x, y in zip(a, b, strict=True)], dtype=float)

    return met.where(first).select("i", "j", shared("corners", "corners2").alias("area")).where("area > 0")


def cut_area(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """The area that two convex polygons share: ``a`` is cut along each edge of ``b``."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    double = lambda c: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(c, [*c[1:], *c[:1]], strict=True))
    sign = 1.0 if double(b) >= 0 else -1.0
    left = list(a)
    for p, q in zip(b, [*b[1:], b[0]], strict=True):
        corners, left = left, []
        for r, s in zip(corners, [*corners[1:], *corners[:1]], strict=True):
            here, there = sign * turn(p, q, r), sign * turn(p, q, s)
            if here >= 0:
                left.append(r)
            if here * there < 0:
                share = here / (here - there)
                left.append((r[0] + (s[0] - r[0]) * share, r[1] + (s[1] - r[1]) * share))
    return abs(double(left)) / 2


def enter_exit(old: DataFrame, new: DataFrame) -> DataFrame:
    """(t, state) of two keyed sets: enter, update or exit."""
    both = old.select("t", F.lit(True).alias("_old")).join(new.select("t", F.lit(True).alias("_new")), "t", "full")
    return both.select("t", F.when(F.col("_old").isNull(), "enter").when(F.col("_new").isNull(), "exit").otherwise("update").alias("state"))


def depths(actions: DataFrame) -> DataFrame:
    """(no, root, depth) of actions(no, parent): each step doubles the length of the jump to an ancestor, until none has one left.

    A tree of depth d takes log2(d) joins, not d. Steps are written to the shared folder.
    """
    jumps = keep(actions.select("no", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "no").alias("root")), "jumps")
    while not jumps.where("up is not null").isEmpty():
        ahead = jumps.select(F.col("no").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("root").alias("_r"))
        joined = jumps.join(ahead, F.col("up") == F.col("_n"), "left")
        before, jumps = jumps, keep(joined.select("no", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.coalesce("_r", "root").alias("root")), "jumps")
        drop(before)
    return jumps.select("no", "root", "depth")
