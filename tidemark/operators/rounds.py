"""Rounds of layouts whose positions fit every task: all of them, one after another, to the last.

The driver holds positions, steps and gains (48 bytes a point) and the tree. Edges are written once, in pieces; each round is one
job in which a task pulls along its piece's edges and pushes its share of the tree's leaves, so a round reads the edges once and
moves 80 bytes or so a point. Up to ALONE points, a round takes less time than a job takes to begin, and one task takes all rounds.

Points are numbered in the order of their t; anchors, which stay, have the numbers after them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import drop, keep
from .quadtree import LEAF, THETA, Tree, _added, codes, pushes

#: Points whose rounds one task takes.
ALONE = 1 << 12
#: Edges of a piece, about.
EDGES = 1 << 21
#: Edges that are summed at a time, and points that meet all anchors at a time.
STRIP, FEW = 1 << 17, 128
#: In the error's logarithm.
SMALL = 1e-12


class Positions:
    """What each task gets of a round: places of points and of ``held`` anchors (x, y, weight), and the points' tree."""

    def __init__(self, at: np.ndarray, held: np.ndarray):
        self.n, self.held = at.shape[1], held
        self.x, self.y = np.concatenate([at, held[:, :2].T], axis=1)
        low, high = at.min(axis=1), at.max(axis=1)
        self.square = float(low[0]), float(low[1]), float((high - low).max()) * (1 + 1e-9) or 1.0
        code = codes(*at, self.square)
        self.order = np.argsort(code, kind="stable")
        self.px, self.py = at[:, self.order]
        self.tree = Tree.of(code[self.order], self.px, self.py, LEAF)
        self.leaves = self.tree.leaves()

    def plain(self) -> dict:
        """As arrays and numbers, which a worker can read before it knows where this library is."""
        return vars(self) | {"tree": vars(self.tree)}

    @classmethod
    def of(cls, plain: dict) -> Positions:
        found = cls.__new__(cls)
        vars(found).update(plain | {"tree": Tree(**plain["tree"])})
        return found

    def pushed(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Points of a share of the leaves and their sums: q, fx, fy of all points, and the same of the anchors."""
        mine = self.leaves[part * len(self.leaves) // parts : (part + 1) * len(self.leaves) // parts]
        if not len(mine):
            return np.zeros(0, np.int64), np.zeros((6, 0))
        here, out = pushes(self.tree, self.square, self.px, self.py, mine, THETA)
        out = np.concatenate([out, np.zeros_like(out)])
        x, y = self.px[here], self.py[here]
        for k in range(0, len(x) if len(self.held) else 0, FEW):
            some = slice(k, k + FEW)
            _added(out[3:, some], x[some], y[some], *self.held.T)
        return self.order[here], out

    def _ways(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dx, dy = self.x[i] - self.x[j], self.y[i] - self.y[j]
        return dx, dy, 1 / (1 + dx * dx + dy * dy)

    def pulled(self, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points from the first to the last of edges sorted by i, and their sums along them: fx, fy to points, and to anchors."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros((4, 0))
        low, n = int(i[0]), int(i[-1] - i[0]) + 1
        out = np.zeros((4, n))
        for k in range(0, len(i), STRIP):
            a, b = i[k : k + STRIP], j[k : k + STRIP]
            dx, dy, f = self._ways(a, b)
            f *= p[k : k + STRIP]
            sides = [(0, slice(None))] if not len(self.held) else [(0, b < self.n), (2, b >= self.n)]
            start, size = int(a[0]) - low, int(a[-1] - a[0]) + 1
            for row, which in sides:
                at = a[which] - a[0]
                out[row, start : start + size] += np.bincount(at, (f * dx)[which], size)
                out[row + 1, start : start + size] += np.bincount(at, (f * dy)[which], size)
        return np.arange(low, low + n), out

    def lost(self, i: np.ndarray, j: np.ndarray, p: np.ndarray, total: float) -> float:
        """The error's part of edges between points."""
        error = 0.0
        for k in range(0, len(i), STRIP):
            a, b, w = (v[k : k + STRIP] for v in (i, j, p))
            _, _, q = self._ways(a, b)
            error += float(np.where(b < self.n, w * np.log((w + SMALL) / (q / total + SMALL)), 0.0).sum())
        return error


class Alone:
    """Sums over edges (i, j, p) that are all at hand."""

    def __init__(self, i: np.ndarray, j: np.ndarray, p: np.ndarray):
        order = np.lexsort((j, i))
        self.edges = i[order], j[order], p[order]

    def sums(self, at: Positions) -> tuple[np.ndarray, np.ndarray]:
        pull, push = np.zeros((4, at.n)), np.zeros((6, at.n))
        for out, (which, found) in ((pull, at.pulled(*self.edges)), (push, at.pushed(0, 1))):
            out[:, which] += found
        return pull, push

    def error(self, at: Positions, total: float) -> float:
        return at.lost(*self.edges, total)


class Jobs:
    """The same with each round's sums as a job over pieces of edges(i, j, p), which are written once."""

    def __init__(self, edges: DataFrame, n: int):
        self.spark = edges.sparkSession
        parts = max(1, self.spark.sparkContext.defaultParallelism, -(-edges.count() // EDGES))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches), schema)
            if table.num_rows:
                i, j, p = (table.column(c).to_numpy() for c in "ijp")
                order = np.lexsort((j, i))
                yield pa.RecordBatch.from_arrays([pa.array([int(i[order[0]])], pa.int64()), *[pa.array([v[order].tobytes()], pa.binary()) for v in (i, j, p)]], ["first", "i", "j", "p"])

        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("p", pa.float64())])
        edges = edges.select(*[F.col(c).cast(k) for c, k in (("i", "long"), ("j", "long"), ("p", "double"))])
        self.pieces = keep(edges.repartitionByRange(parts, "i").mapInArrow(pack, "first long, i binary, j binary, p binary"), "pieces")
        firsts = np.sort([r[0] for r in self.pieces.select("first").collect()])
        self.share = {int(first): k for k, first in enumerate(firsts)}

    def _told(self, at: Positions, what: Callable) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """What ``what(positions, part, parts, edges)`` gives for each piece: kind, numbers and values."""
        sent, share = self.spark.sparkContext.broadcast(at.plain()), self.share

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = Positions.of(sent.value)
            for batch in batches:
                for first, *edges in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    edges = [np.frombuffer(v, kind) for v, kind in zip(edges, (np.int64, np.int64, float), strict=True)]
                    for kind, which, values in what(at, share[first], len(share), edges):
                        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([which.astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["kind", "which", "values"])

        found = self.pieces.mapInArrow(run, "kind int, which binary, values binary").toArrow()
        sent.destroy()  # the next round has its own
        rows = zip(*[found.column(c).to_pylist() for c in ("kind", "which", "values")], strict=True)
        return sorted(((kind, np.frombuffer(which, np.int64), np.frombuffer(values, float)) for kind, which, values in rows), key=lambda r: (r[0], r[1][:1].tolist()))

    def sums(self, at: Positions) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((4, at.n)), np.zeros((6, at.n))
        for kind, which, values in self._told(at, lambda at, part, parts, edges: ((0, *at.pulled(*edges)), (1, *at.pushed(part, parts)))):
            out[kind][:, which] += values.reshape(len(out[kind]), -1)
        return out

    def error(self, at: Positions, total: float) -> float:
        found = self._told(at, lambda at, part, parts, edges: [(0, np.array([part]), np.array([at.lost(*edges, total)]))])
        return float(sum(v[0] for _, _, v in found))


class State:
    """Positions, last steps and gains, as ``layout.resting`` and ``layout.stepped``."""

    def __init__(self, at: np.ndarray):
        self.at, self.step, self.gain = at, np.zeros_like(at), np.ones_like(at)

    def move(self, g: np.ndarray, momentum: float, rate: float) -> None:
        self.gain = np.maximum(np.where(self.step * g < 0, self.gain + 0.2, self.gain * 0.8), 0.01)
        self.step = momentum * self.step - rate * self.gain * 4 * g
        self.at = np.floor((self.at + self.step) * 1e9) * 1e-9


NONE = np.zeros((0, 3))


def first_layout(by: Alone | Jobs, at: np.ndarray, rounds: int) -> np.ndarray:
    """Positions (x, y by point) after all rounds, the first quarter with exaggeration."""
    state, rate = State(at), max(at.shape[1] / 12.0, 50.0)
    for k in range(rounds):
        pull, push = by.sums(Positions(state.at, NONE))
        early = k < rounds // 4
        state.move(pull[:2] * (12.0 if early else 1.0) - push[1:3] / push[0].sum(), 0.5 if early else 0.8, rate)
    return state.at


def next_layout(by: Alone | Jobs, at: np.ndarray, held: np.ndarray, rounds: int, blend: float, stale: int) -> np.ndarray:
    """Positions after rounds with own and anchors' forces; ends once the error, taken every tenth round, has not improved for ``stale`` rounds, with the best ones."""
    state, rate = State(at), max(at.shape[1] / 12.0, 50.0)
    best, least, since = at, np.inf, 0
    for turn in range(rounds):
        now = Positions(state.at, held)
        pull, push = by.sums(now)
        if turn % 10 == 0:
            error = by.error(now, push[0].sum())
            best, least, since = (state.at, error, 0) if error < least else (best, least, since + 10)
            if since >= stale:
                return best
        own, ties = pull[:2] - push[1:3] / push[0].sum(), pull[2:] - push[4:] / push[3].sum()
        state.move((1 - blend) * own + blend * ties, 0.5 if turn < 250 else 0.8, rate)
    return state.at


def laid_out(edges: DataFrame, start: DataFrame, layout: Callable[[Alone | Jobs, np.ndarray], np.ndarray], anchors: DataFrame | None = None) -> DataFrame:
    """(t, x, y), written once, of ``layout`` from start(t, x, y) along edges(i, j, p) between points, and ``anchors(i, j, p)`` to anchors by their numbers."""
    spark, table = start.sparkSession, start.select(F.col("t").cast("long").alias("t"), "x", "y").toArrow().sort_by("t")
    t, at = table.column("t").to_numpy(), np.stack([table.column(c).to_numpy() for c in "xy"])
    n = len(t)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, p, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "p", "tie"))
            j = np.where(tie, j + n, np.searchsorted(t, j))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(t, i)), pa.array(j), pa.array(p)], ["i", "j", "p"])

    every = edges.select("i", "j", "p", F.lit(False).alias("tie"))
    if anchors is not None:
        every = every.unionByName(anchors.select("i", F.col("j").cast("long").alias("j"), "p", F.lit(True).alias("tie")))
    numbered = every.mapInArrow(number, "i long, j long, p double")
    if n > ALONE:
        by = Jobs(numbered, n)
        found = layout(by, at)
        drop(by.pieces)
        return keep(spark.createDataFrame(pa.table([pa.array(t), *map(pa.array, found)], names=["t", "x", "y"])), "layout")
    found = numbered.toArrow()
    edges = [found.column(c).to_numpy() for c in "ijp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(t), *map(pa.array, layout(Alone(*edges), at))], ["t", "x", "y"])

    return keep(spark.range(0, 1, 1, 1).mapInArrow(run, "t long, x double, y double"), "layout")
