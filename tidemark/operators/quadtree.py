"""Repulsion in the plane by an adaptive quad-tree, after Barnes and Hut.

The bounding square is quartered; a cell with more than ``leaf`` points is quartered again, down to DEPTH levels (points
that agree so far stay together). Points are summed cell against cell: a cell that is far from all of a leaf (its side
below ``theta`` times its least distance) counts as its points at their mean for all points of the leaf; else its quarters
are looked at, and of leaves the points themselves, so what is near is exact at any size.

Up to SENT points (16 MB) everything is sent to all tasks, and each takes some of the leaves. Beyond that the tree is a
table, made some levels at a time of the points whose cells are still large. Leaves are taken together by groups, the
largest cells of no more than a share of all points; pairs of a group and a cell are opened level by level as joins, and
a group's tasks get the means that its leaves may see and the points of leaves near to it. So points are copied once a
group and not once a leaf, and groups grow with the table. Both ways give the same sums but for their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep

#: Levels of the tree at most: two bits of a point's code each.
DEPTH = 24
LEAF, THETA, SENT = 32, 0.3, 1 << 20
#: Levels that one pass over the points counts.
AT_ONCE = 6
#: How many groups of leaves there are about, the least and the most points that limit one, points that a task gets from others, and those of a list, at most.
GROUPS, LEAST, MOST, PIECE, CHUNK = 32, 2048, 1 << 16, 1 << 18, 1024
#: Pairs of points that are summed at a time, if they stand in a matrix.
IN_CACHE = 1 << 16


def _square(at: DataFrame) -> tuple[float, float, float] | None:
    ends = at.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if ends[0] is None else (ends[0], ends[1], max(ends[2] - ends[0], ends[3] - ends[1]) * (1 + 1e-9) or 1.0)


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of a number of 24 bits with a zero between each two."""
    v = v.astype(np.int64)
    for shift, mask in ((24, 0x000000FFFFFF), (16, 0x00FF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        if shift < 24:
            v = (v | (v << shift)) & mask
    return v


def codes(x: np.ndarray, y: np.ndarray, square: tuple[float, float, float]) -> np.ndarray:
    """Each point's cell of the last level, as its quarters from the whole square down."""
    cell = lambda v, low: np.clip(np.floor((v - low) / square[2] * 2**DEPTH), 0, 2**DEPTH - 1).astype(np.int64)
    return _spread(cell(x, square[0])) | _spread(cell(y, square[1])) << 1


def _gathered(code: np.ndarray) -> np.ndarray:
    """Every other bit of a code, from the last on."""
    v = code & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v


def boxes(level: np.ndarray, code: np.ndarray, square: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and lower ends and sides of cells."""
    side = square[2] / 2.0**level
    return square[0] + _gathered(code) * side, square[1] + _gathered(code >> 1) * side, side


def far(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], theta: float) -> np.ndarray:
    """Whether cells b are far from cells a: side against the least distance of the two boxes."""
    gap = lambda k: np.maximum(np.maximum(b[k] - (a[k] + a[2]), a[k] - (b[k] + b[2])), 0.0)
    return b[2] < theta * np.hypot(gap(0), gap(1))


@dataclass
class Tree:
    """Cells level by level: their level, code, first point and number of points (in the order of codes), means, first quarter and number of quarters."""

    level: np.ndarray
    code: np.ndarray
    start: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, x: np.ndarray, y: np.ndarray, leaf: int) -> Tree:
        """Of points sorted by code."""
        sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, y)]
        parts = []
        start, n, own, total = np.zeros(1, np.int64), np.array([len(code)]), np.zeros(1, np.int64), 1
        for level in range(DEPTH + 1):
            open_ = np.flatnonzero((n > leaf) & (level < DEPTH))
            child, children = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            who = np.repeat(open_, n[open_])
            at = start[who] + np.arange(len(who)) - np.repeat(np.cumsum(n[open_]) - n[open_], n[open_])
            below = code[at] >> 2 * (DEPTH - level - 1)
            first = np.flatnonzero(np.concatenate([[True], (below[1:] != below[:-1]) | (who[1:] != who[:-1])])) if len(who) else np.zeros(0, np.int64)
            np.add.at(children, who[first], 1)
            child[open_] = total + np.cumsum(children[open_]) - children[open_]
            parts.append((np.full(len(n), level), own, start, n, (sums[0][start + n] - sums[0][start]) / n, (sums[1][start + n] - sums[1][start]) / n, child, children))
            total += len(first)
            if not len(first):
                break
            own, start, n = below[first], at[first], np.diff(np.append(first, len(at)))
        return cls(*[np.concatenate([p[k] for p in parts]) for k in range(8)])

    def leaves(self) -> np.ndarray:
        """In the order of their points: each point is in one of them."""
        found = np.flatnonzero(self.children == 0)
        return found[np.argsort(self.start[found])]


def _pairs(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of stretches a (first, number) with those of stretches b."""
    sizes = an * bn
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.repeat(np.maximum(bn, 1), sizes)
    return np.repeat(a, sizes) + k // wide, np.repeat(b, sizes) + k % wide


def _of_leaf(own: np.ndarray, met: np.ndarray, first: int) -> np.ndarray:
    """Sums (q, fx, fy) of points own(x, y) over all of met(x, y, n), where the points themselves stand from place ``first`` on and don't meet themselves.

    By products of matrices, with the leaf in the middle: what is near is small there, so nothing is lost in differences.
    """
    xy, to, size = own[:2] - own[:2, :1], met[:2] - own[:2, :1], own.shape[1]
    left, right, weight, out = np.ones((size, 4)), np.ones((4, met.shape[1])), np.empty((met.shape[1], 3)), np.zeros((3, size))
    left[:, :2], right[:2] = xy.T, -2 * to
    left[:, 2] += (xy * xy).sum(axis=0)
    right[3] = (to * to).sum(axis=0)
    weight[:, 0], weight[:, 1:] = met[2], (to * met[2]).T
    step = max(1, IN_CACHE // 2 // size)
    for k in range(0, met.shape[1], step):
        q = left @ right[:, k : k + step]
        np.divide(1.0, q, out=q)
        a, b = max(first - k, 0), min(first + size - k, q.shape[1])
        if a < b:
            q[np.arange(a, b) + k - first, np.arange(a, b)] = 0.0
        out[0] += q @ weight[k : k + step, 0]
        q *= q
        found = (q @ weight[k : k + step]).T
        out[1:] += xy * found[0] - found[1:]
    return out


def pushes(tree: Tree, square: tuple[float, float, float], x: np.ndarray, y: np.ndarray, mine: np.ndarray, theta: float) -> tuple[slice, np.ndarray]:
    """Which points the leaves ``mine`` have, which follow each other, and their sums (q, fx, fy by point), leaf by leaf."""
    here = slice(int(tree.start[mine[0]]), int(tree.start[mine[-1]] + tree.n[mine[-1]]))
    out, box = np.zeros((3, here.stop - here.start)), boxes(tree.level, tree.code, square)
    a, b = np.arange(len(mine)), np.zeros(len(mine), np.int64)
    means, near = [], []
    while len(a):
        away = far(tuple(v[mine[a]] for v in box), tuple(v[b] for v in box), theta)
        means.append((a[away], b[away]))
        ends = ~away & (tree.children[b] == 0)
        near.append((a[ends], b[ends]))
        opened = ~away & (tree.children[b] > 0)
        a, b = _pairs(a[opened], np.ones(opened.sum(), np.int64), tree.child[b[opened]], tree.children[b[opened]])
    means, near = (tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1)) for parts in (means, near))
    means, near = (tuple(v[np.argsort(p[0], kind="stable")] for v in p) for p in (means, near))
    cuts = [np.searchsorted(p[0], np.arange(len(mine) + 1)) for p in (means, near)]
    cells, points = np.stack([tree.x, tree.y, tree.n]), np.stack([x, y, np.ones(len(x))])
    for k, leaf in enumerate(mine.tolist()):
        start, n = int(tree.start[leaf]), int(tree.n[leaf])
        some = near[1][cuts[1][k] : cuts[1][k + 1]]  # the leaf itself among them
        sizes = tree.n[some]
        before = np.cumsum(sizes) - sizes
        c = np.repeat(tree.start[some] - before, sizes) + np.arange(int(sizes.sum()))
        some_cells = means[1][cuts[0][k] : cuts[0][k + 1]]
        first = len(some_cells) + int(before[np.flatnonzero(some == leaf)[0]])
        out[:, start - here.start : start - here.start + n] = _of_leaf(points[:, start : start + n], np.concatenate([cells[:, some_cells], points[:, c]], axis=1), first)
    return here, out


def _by_tasks(at: DataFrame, square: tuple[float, float, float], theta: float, leaf: int) -> DataFrame:
    table = at.select(F.col("t").cast("long").alias("t"), "x", "y").toArrow()
    t, x, y = (table.column(c).to_numpy() for c in ("t", "x", "y"))
    code = codes(x, y, square)
    order = np.lexsort((t, code))
    t, x, y = t[order], x[order], y[order]
    tree = Tree.of(code[order], x, y, leaf)
    leaves = tree.leaves()
    spark = at.sparkSession
    parts = max(1, min(len(leaves) // 64, 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                mine = leaves[part * len(leaves) // parts : (part + 1) * len(leaves) // parts]
                if not len(mine):
                    continue
                here, out = pushes(tree, square, x, y, mine, theta)
                yield pa.RecordBatch.from_arrays([pa.array(t[here]), *[pa.array(v) for v in out]], ["i", "q", "fx", "fy"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "i long, q double, fx double, fy double")


def _coded(at: DataFrame, square: tuple[float, float, float]) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes(x, y, square))], ["t", "x", "y", "code"])

    return keep(at.select(F.col("t").cast("long").alias("t"), "x", "y").mapInArrow(run, "t long, x double, y double, code long"), "coded")


def _above(level: Column) -> Column:
    """A point's cell on a level."""
    return F.expr("shiftright(code, cast(2 * (%d - level) as int))" % DEPTH)


def cells(coded: DataFrame, leaf: int) -> DataFrame:
    """(level, cell, n, x, y, open) of the tree of points(t, x, y, code), written once."""
    found, rest, low = None, coded, 0
    while True:
        high = min(low + AT_ONCE, DEPTH)
        counted = rest.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high))))
        counted = counted.withColumn("cell", _above(F.col("level"))).groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
        counted = keep(counted.withColumn("open", (F.col("n") > leaf) & (F.col("level") < DEPTH)), "counted")
        # A cell is there if the one above is open; counts fall on the way down, so that is all it takes.
        parents = counted.where("open").select((F.col("level") + 1).alias("level"), F.col("cell").alias("_above"))
        there = counted.withColumn("_above", F.shiftright("cell", 2)).join(parents, ["level", "_above"], "left_semi").drop("_above")
        some = there if low else counted.where("level = 0").unionByName(there)
        found = some if found is None else found.unionByName(some)
        deepest = counted.where(F.col("open") & (F.col("level") == high))
        if deepest.isEmpty():
            return keep(found.withColumn("level", F.col("level").cast("int")), "tree")
        rest = keep(rest.withColumn("level", F.lit(high)).withColumn("cell", _above(F.lit(high))).join(deepest.select("cell"), "cell", "left_semi").select("t", "x", "y", "code"), "rest")
        low = high


def _groups(tree: DataFrame, most: int) -> DataFrame:
    """(gl, gc, parts): the largest cells with ``most`` points or fewer, or that can't be opened; each leaf is in one of them."""
    above = tree.select((F.col("level") + 1).alias("level"), F.col("cell").alias("_above"), F.col("n").alias("_n"))
    known = tree.withColumn("_above", F.shiftright("cell", 2)).join(above, ["level", "_above"], "left")
    found = known.where(((F.col("n") <= most) | ~F.col("open")) & (F.col("_n").isNull() | (F.col("_n") > most)))
    return keep(found.select(F.col("level").alias("gl"), F.col("cell").alias("gc"), F.ceil(F.col("n") / most).cast("int").alias("parts")), "groups")


def _packed(coded: DataFrame, leaves: DataFrame, levels: list[int]) -> DataFrame:
    """(level, cell, chunk, ts, xs, ys): the points of leaves as lists, CHUNK or so of them at most."""
    points = coded.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("cell", _above(F.col("level"))).join(leaves, ["level", "cell"])
    points = points.withColumn("chunk", F.pmod(F.xxhash64("t"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    return keep(points.groupBy("level", "cell", "chunk").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("t", "x", "y")]), "points")


def _lists(table: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the lists of a column start, with the end of the last, and the values of each column one after another."""
    columns = [table.column(k).combine_chunks() for k in names]
    return np.concatenate([[0], np.cumsum(columns[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def _added(out: np.ndarray, x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, n: np.ndarray | None, apart: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Adds to ``out`` (q, fx, fy by point) what all q do to all points; ``apart``: rows and columns that don't meet."""
    step = max(1, IN_CACHE // len(x))
    for k in range(0, len(qx), step):
        dx, dy = x[:, None] - qx[None, k : k + step], y[:, None] - qy[None, k : k + step]
        q = dx * dx
        q += dy * dy
        q += 1
        np.divide(1.0, q, out=q)
        if apart is not None:
            here = (apart[1] >= k) & (apart[1] < k + step)
            q[apart[0][here], apart[1][here] - k] = 0.0
        weight = q if n is None else q * n[None, k : k + step]
        out[0] += weight.sum(axis=1)
        weight = weight * q
        out[1] += np.einsum("nm,nm->n", weight, dx)
        out[2] += np.einsum("nm,nm->n", weight, dy)


def _by_joins(at: DataFrame, square: tuple[float, float, float], theta: float, leaf: int, most: int | None = None, piece: int = PIECE) -> DataFrame:
    coded = _coded(at, square)
    tree = cells(coded, leaf)
    levels = [r[0] for r in tree.select("level").distinct().orderBy("level").collect()]
    groups = _groups(tree, most or max(LEAST, min(MOST, coded.count() // GROUPS)))
    leaves = tree.where("not open").select("level", "cell", "n")
    packed = _packed(coded, leaves, levels)

    def judge(batches):
        for batch in batches:
            gl, gc, level, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("gl", "gc", "level", "cell"))
            away = far(boxes(gl, gc, square), boxes(level, cell, square), theta)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away)], [*batch.schema.names, "far"])

    kinds = "gl int, gc long, level int, cell long, n long, x double, y double, open boolean"
    front = groups.select("gl", "gc").crossJoin(F.broadcast(tree.where("level = 0")))  # one row: the whole square
    means, near = [], []
    for level in levels:
        judged = keep(front.select("gl", "gc", "level", "cell", "n", "x", "y", "open").mapInArrow(judge, kinds + ", far boolean"), "pairs")
        means.append(judged.select("gl", "gc", "level", "cell", "n", "x", "y"))
        near.append(judged.where("not far and not open").select("gl", "gc", "level", "cell", "n"))
        quarters = tree.where(F.col("level") == level + 1).withColumn("_above", F.shiftright("cell", 2))
        front = judged.where("not far and open").select("gl", "gc", F.col("cell").alias("_above")).join(quarters, "_above")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    near = union(near)
    sizes = keep(groups.join(near.groupBy("gl", "gc").agg(F.ceil(F.sum("n") / piece).cast("int").alias("pieces")), ["gl", "gc"]), "sizes")

    lists = ["level", "cell", "n", "ts", "xs", "ys"]  # n: points that a mean stands for; of points themselves null
    seen = near.drop("n").join(packed, ["level", "cell"]).withColumn("n", F.lit(None).cast("double")).select("gl", "gc", "chunk", *lists)
    if theta > 0:
        some = union(means).select("gl", "gc", F.lit(0).alias("chunk"), "level", "cell", F.col("n").cast("double").alias("n"), F.array().cast("array<long>").alias("ts"), F.array("x").alias("xs"), F.array("y").alias("ys"))
        seen = seen.unionByName(some)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("level", "cell", "chunk"), F.col(c)).cast("int")
    seen = seen.join(sizes, ["gl", "gc"]).withColumn("_piece", dealt("pieces")).withColumn("_part", every("parts"))
    up = leaves.select("level", "cell", F.explode(F.sequence(F.lit(0), "level")).alias("gl"))
    up = up.withColumn("gc", F.expr("shiftright(cell, cast(2 * (level - gl) as int))"))
    own = up.join(sizes, ["gl", "gc"]).join(packed, ["level", "cell"]).withColumn("_part", dealt("parts")).withColumn("_piece", every("pieces"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        l, c = (mine.column(k).to_numpy() for k in ("level", "cell"))
        start, (t, x, y) = _lists(mine, "ts", "xs", "ys")
        out = np.zeros((3, len(t)))
        points = np.asarray(theirs.column("n").is_null())
        near, mean = theirs.filter(pa.array(points)), theirs.filter(pa.array(~points))
        level, cell = (near.column(k).to_numpy() for k in ("level", "cell"))
        _, (u, ux, uy) = _lists(near, "ts", "xs", "ys")
        cut = np.diff(_lists(near, "ts")[0])
        ml, mc, mn = (mean.column(k).to_numpy() for k in ("level", "cell", "n"))
        _, (mx, my) = _lists(mean, "xs", "ys")
        box, close, cells_, above = boxes(l, c, square), boxes(level, cell, square), boxes(ml, mc, square), boxes(ml - 1, mc >> 2, square)
        for k in range(len(l)):
            here, me = slice(start[k], start[k + 1]), tuple(v[k] for v in box)
            # What is far from a leaf has only far cells below it: its mean counts where the cell above is not far yet.
            some = far(me, cells_, theta) & ~far(me, above, theta)
            _added(out[:, here], x[here], y[here], mx[some], my[some], mn[some])
            met = np.repeat(~far(me, close, theta), cut)
            same = np.flatnonzero(np.repeat((level == l[k]) & (cell == c[k]), cut))  # a leaf is not far from itself
            order = same[np.argsort(u[same], kind="stable")]
            first = np.searchsorted(u[order], t[here])
            times = np.searchsorted(u[order], t[here], "right") - first
            r = np.repeat(np.arange(len(times)), times)
            columns = order[first[r] + np.arange(len(r)) - (np.cumsum(times) - times)[r]]
            if met.all():
                _added(out[:, here], x[here], y[here], ux, uy, None, (r, columns))
            else:
                _added(out[:, here], x[here], y[here], ux[met], uy[met], None, (r, (np.cumsum(met) - 1)[columns]))
        return pa.table([pa.array(t), *[pa.array(v) for v in out]], names=["i", "q", "fx", "fy"])

    key = ["gl", "gc", "_part", "_piece"]
    own = own.select(*[F.col(c).alias(c) for c in (*key, "level", "cell", "ts", "xs", "ys")])  # columns of its own
    met = own.groupBy(*key).cogroup(seen.select(*key, *lists).groupBy(*key))
    return met.applyInArrow(run, "i long, q double, fx double, fy double").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("q", "fx", "fy")])


def repulsion_by_tree(at: DataFrame, theta: float = THETA, leaf: int = LEAF, sent: int = SENT) -> DataFrame:
    """(i, q, fx, fy) of at(t, x, y): as ``layout.repulsion``, with far cells at their means; with ``theta`` 0 exact."""
    square = _square(at)
    if square is None:
        return at.sparkSession.createDataFrame([], "i long, q double, fx double, fy double")
    return (_by_tasks if at.limit(sent + 1).count() <= sent else _by_joins)(at, square, theta, leaf)
