"""Contour lines of a density on cells: marching squares, and their pieces joined to rings.

The cells' middles are the corners of squares; a missing cell is 0, so every line is closed. Where a level crosses a side
of a square is a point known by that side, and each square's pieces lead from side to side with the higher ground
on their left, so each point has one next point. Rings are the cycles of these steps: the least point of each is
found by steps that double their length, then the distance to it, as joins. Only a ring's own corners come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import drop, keep
from .views import depths

#: By which corners are above (1 lower left, 2 lower right, 4 upper right, 8 upper left): pieces from side to side (0 lower, 1 right, 2 upper, 3 left).
PIECES = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 3), (2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 10: [(1, 0), (3, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}


def pieces(cells: DataFrame, levels: list[float]) -> DataFrame:
    """(level, a, b, ax, ay, bx, by): each square's pieces of cells(gx, gy, density); a and b are (x, y, across), the side's first corner and whether it runs along x."""
    corner = F.inline(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    spread = cells.select("gx", "gy", F.col("density").cast("double").alias("d"), corner)
    value = lambda dx, dy: F.coalesce(F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("d"))), F.lit(0.0))
    squares = spread.groupBy((F.col("gx") - F.col("dx")).cast("long").alias("x"), (F.col("gy") - F.col("dy")).cast("long").alias("y")).agg(value(0, 0).alias("v0"), value(1, 0).alias("v1"), value(1, 1).alias("v2"), value(0, 1).alias("v3"))
    squares = squares.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    case = sum(F.when(F.col(f"v{k}") >= F.col("level"), 1 << k).otherwise(0) for k in range(4))
    steps = F.lit(None).cast("array<struct<f: int, t: int>>")
    for k, some in PIECES.items():
        steps = F.when(F.col("case") == k, F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in some])).otherwise(steps)
    moved = squares.withColumn("case", case).select("*", F.inline(steps))
    x, y, level = F.col("x"), F.col("y"), F.col("level")
    part = lambda p, q: (level - F.col(p)) / (F.col(q) - F.col(p))
    sides = [((x, y, True), (x + part("v0", "v1"), y.cast("double"))), ((x + 1, y, False), (x + 1.0, y + part("v1", "v2"))), ((x, y + 1, True), (x + part("v3", "v2"), y + 1.0)), ((x, y, False), (x.cast("double"), y + part("v0", "v3")))]

    def at(end: str) -> list[Column]:
        pick = lambda values: F.when(F.col(end) == 0, values[0]).when(F.col(end) == 1, values[1]).when(F.col(end) == 2, values[2]).otherwise(values[3])
        key = pick([F.struct(kx.alias("x"), ky.alias("y"), F.lit(across).alias("across")) for (kx, ky, across), _ in sides])
        return [key, pick([p for _, (p, _) in sides]), pick([q for _, (_, q) in sides])]

    a, b = at("f"), at("t")
    return moved.select("level", a[0].alias("a"), b[0].alias("b"), a[1].alias("ax"), a[2].alias("ay"), b[1].alias("bx"), b[2].alias("by"))


def rings(found: DataFrame) -> DataFrame:
    """(level, ring, n, area, corners) of ``pieces``: corners (x, y) in turn; the area is positive around higher ground."""
    found = keep(found.withColumn("no", F.struct("level", "a")).withColumn("next", F.struct("level", F.col("b").alias("a"))), "pieces")
    now = keep(found.select("no", F.col("next").alias("up"), F.least("no", "next").alias("least")), "least")
    changed = True
    while changed:
        ahead = now.select(F.col("no").alias("_n"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        moved = now.join(ahead, F.col("up") == F.col("_n")).select("no", F.col("_up").alias("up"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("less"))
        before, now = now, keep(moved, "least")
        changed = not now.where("less").isEmpty()
        drop(before)
    # From its least point a ring is a line: each point's distance to the end tells its turn.
    first = now.where("no = least").select(F.col("no").alias("_first"))
    line = found.select("no", "next", "ax", "ay").join(first, F.col("next") == F.col("_first"), "left")
    turns = depths(line.select("no", F.when(F.col("_first").isNull(), F.col("next")).alias("parent")))
    of = found.select("no", F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("cross"))
    points = of.join(turns, "no").select(F.col("no.level").alias("level"), F.col("root").alias("ring"), (-F.col("depth")).alias("turn"), "x", "y", "cross")
    corners = F.transform(F.array_sort(F.collect_list(F.struct("turn", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.groupBy("level", "ring").agg(F.count(F.lit(1)).alias("n"), (F.sum("cross") / 2).alias("area"), corners.alias("corners"))
