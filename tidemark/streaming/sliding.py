"""Drift of sliding windows as keyed state: each label's window is followed row by row, and labels run side by side.

Rows come as (t, label, v, near), near being their nearest training rows (j, v). A label's part of the window changes
where one of its rows comes and, ``width`` rows later, leaves. Its state holds those rows, their training rows with
the number of rows that have each, and the sums of distances A (across), B (within the window) and C (within the
training rows); a row that comes or leaves changes the sums by its own distances only. Between changes the label's
score holds for a stretch of the order, which is put out once nothing can change it any more.

So that labels without rows in a batch get on too, a batch ends with a mark (v null) for each label.

That is what ``Followed`` does, a row at a time. A stream of many rows has them in ``packed`` stretches, and ``Batched`` takes
all rows of a label's batch at once, with the same scores: sums over windows are differences of running sums over some hundred
rows, so nothing is made row by row; its state is the rows of the last window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drift import GUARD
from ..operators.pairs import SENT, OnAxis, distance_block, matrix, nearest_of_label, vectors

#: Changes after which the sums are made anew, so that rounding does not add up.
ANEW = 1000
#: Changes that are scored together, if they have to do with MANY training rows at most, and else; places whose scores are put out together.
TOGETHER, MANY, FEWER, PLACES = 1024, 256, 64, 4096
#: What a packed stretch of a label's rows holds of them as bytes: a number, an axis after the other, how many neighbours, and those' numbers and axes.
HELD = {"ts": np.int64, "v": np.float64, "counts": np.int64, "js": np.int64, "near": np.float64}


class Followed:
    """A label's part of a window of ``width`` rows."""

    def __init__(self, width: int, kept: str | None = None):
        self.width = width
        state = json.loads(kept) if kept else {"at": None, "rows": [], "near": [], "sums": [0.0, 0.0, 0.0], "changes": 0}
        self.at: int | None = state["at"]
        self.rows: list[tuple[int, list[float], list[list]]] = [tuple(r) for r in state["rows"]]
        self.near: dict[int, list] = {j: [n, v] for j, n, v in state["near"]}
        self.a, self.b, self.c = state["sums"]
        self.changes: int = state["changes"]

    def dump(self) -> str:
        return json.dumps({"at": self.at, "rows": self.rows, "near": [[j, n, v] for j, (n, v) in self.near.items()], "sums": [self.a, self.b, self.c], "changes": self.changes})

    @staticmethod
    def _sum(x: list[float], others: list[list[float]]) -> float:
        return float(distance_block(np.array([x]), np.array(others)).sum()) if others else 0.0

    def _window(self) -> list[list[float]]:
        return [v for _, v, _ in self.rows]

    def _trained(self) -> list[list[float]]:
        return [v for _, v in self.near.values()]

    def _count(self, near: list[list], step: int) -> None:
        for j, v in near:
            n = self.near.get(j, [0, v])[0]
            if step < 0 and n == 1:
                del self.near[j]
            if n == (0 if step > 0 else 1):  # comes or goes
                self.a += step * self._sum(v, self._window())
                self.c += step * 2 * self._sum(v, self._trained())
            if n + step > 0:
                self.near[j] = [n + step, v]

    def _come(self, row: tuple[int, list[float], list[list]]) -> None:
        self.a += self._sum(row[1], self._trained())
        self.b += 2 * self._sum(row[1], self._window())
        self.rows.append(row)
        self._count(row[2], 1)
        self._changed()

    def _leave(self) -> None:
        _, v, near = self.rows[0]
        self._count(near, -1)
        self.rows.pop(0)
        self.a -= self._sum(v, self._trained())
        self.b -= 2 * self._sum(v, self._window())
        self._changed()

    def _changed(self) -> None:
        self.changes += 1
        if self.changes % ANEW == 0 or not self.rows or not self.near:
            window, trained = self._window(), self._trained()
            total = lambda x, y: float(distance_block(np.array(x), np.array(y)).sum()) if x and y else 0.0
            self.a, self.b, self.c = total(window, trained), total(window, window), total(trained, trained)

    def score(self) -> float:
        w, t = len(self.rows), len(self.near)
        if not w or not t:
            return float(w)
        if self.a < GUARD:
            return 0.0
        return w * (1 - (self.b / (w * w) + self.c / (t * t)) / (2 * self.a / (w * t)))

    def _until(self, t: int) -> Iterator[tuple[int, int, float]]:
        if self.rows and t > self.at:
            yield self.at, t, self.score()
        self.at = t

    def on(self, t: int, v: list[float] | None, near: list[list] | None) -> Iterator[tuple[int, int, float]]:
        """The stretches (from, before, score) that are settled by a row at t, or by a mark that t is over."""
        upto = t if v is not None else t + 1
        while self.rows and self.rows[0][0] + self.width <= upto:
            yield from self._until(self.rows[0][0] + self.width)
            self._leave()
        yield from self._until(upto)
        if v is not None:
            self._come((t, v, near or []))


class Packed:
    """A label's rows of a batch as flat arrays, some 100 bytes a row instead of an object for each training row of each row."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        parts: list[tuple[np.ndarray, ...]] = []
        for rows in batches:
            vs = [np.asarray(v, float) if v is not None else np.zeros(0) for v in rows["v"]]
            near = [n if n is not None else () for n in rows["near"]]
            flat = [r for n in near for r in n]
            coordinates = np.concatenate([np.asarray(r["v"], float) for r in flat]) if flat else np.zeros(0)
            parts.append((rows["t"].to_numpy(np.int64), np.array([v is None for v in rows["v"]], bool), np.array([len(v) for v in vs], np.int64), np.concatenate(vs) if vs else np.zeros(0), np.array([len(n) for n in near], np.int64), np.array([r["j"] for r in flat], np.int64), coordinates))
        whole = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.t, self.mark, self.sizes, self.v = (whole(k, kind) for k, kind in enumerate((np.int64, bool, np.int64, float)))
        self.counts, self.j, self.near = whole(4, np.int64), whole(5, np.int64), whole(6, float)

    def in_order(self) -> Iterator[tuple[int, list[float] | None, list[list] | None]]:
        """(t, v, near) by t, marks last; a mark has neither."""
        at, first = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.counts) - self.counts
        for k in np.lexsort((self.mark, self.t)):
            t = int(self.t[k])
            if self.mark[k]:
                yield t, None, None
                continue
            d, j, n = self.sizes[k], first[k], self.counts[k]
            own = self.near[j * d : (j + n) * d].reshape(n, d).tolist()
            yield t, self.v[at[k] : at[k] + d].tolist(), [[int(i), v] for i, v in zip(self.j[j : j + n].tolist(), own, strict=True)]


def with_near(rows: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """``rows(t, v or x, label)`` with their k nearest of ``trained`` of their label: (t, label, v, near)."""
    near = nearest_of_label(rows, trained, k).select(F.col("i").alias("_i"), "j")
    rows, trained = vectors(rows).select("t", "v", "label"), vectors(trained).select("t", "v", "label")
    pairs = near.join(trained.select(F.col("t").alias("j"), F.col("v").alias("_v")), "j").groupBy("_i").agg(F.array_sort(F.collect_list(F.struct("j", F.col("_v").alias("v")))).alias("near"))
    return rows.join(pairs, F.col("t") == F.col("_i"), "left").select("t", "label", "v", F.coalesce("near", F.array().cast("array<struct<j: long, v: array<double>>>")).alias("near"))


def packed(rows: DataFrame, trained: DataFrame, k: int, low: int, high: int, parts: int) -> DataFrame:
    """(t, label, ts, v, counts, js, near): ``rows(t, v or x, label)`` with their k nearest of ``trained``, as stretches of a label's rows.

    Places from ``low`` to ``high`` are cut into ``parts`` batches, and a stretch has rows of one; t is the first. On one axis neighbours are found
    in sorted arrays on the way, so nothing is shuffled if training rows fit in every task.
    """
    sent = None
    if "x" in rows.columns and "x" in trained.columns and trained.limit(SENT + 1).count() <= SENT:
        sent = OnAxis(trained.select(F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), "label"))
        rows = vectors(rows).select(F.col("t").cast("long").alias("t"), "label", "v")
    else:
        rows = with_near(rows, trained, k).select(F.col("t").cast("long").alias("t"), "label", "v", F.col("near.j").alias("js"), F.flatten("near.v").alias("near"))
    kind = rows.schema["label"].dataType.simpleString()

    def neighbours(batch: pa.RecordBatch, label, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if sent is None:
            js, near = (batch.column(c).take(pa.array(at)) for c in ("js", "near"))
            return js.value_lengths().to_numpy(), js.flatten().to_numpy(), near.flatten().to_numpy()
        found = np.zeros((len(at), k), bool)
        j, y = np.zeros((len(at), k), np.int64), np.zeros((len(at), k))
        ok = np.flatnonzero(np.isfinite(v[:, 0]))
        if label in sent.sides:
            j[ok], y[ok], d = sent.nearest(label, v[ok, 0], k)
            found[ok] = np.isfinite(d)
        return found.sum(axis=1), j[found], y[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, v = batch.column("t").to_numpy(), matrix(pa.Table.from_batches([batch]))
            part = ((t - low + 1) * parts - 1) // (high + 1 - low)  # the last that begins at t or before
            names = batch.column("label").dictionary_encode(null_encoding="encode")
            groups = names.indices.to_numpy() * parts + part
            order = np.lexsort((t, groups))
            for at in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(order) else ():
                label = names.dictionary[int(groups[at[0]]) // parts]
                held = (t[at], v[at], *neighbours(batch, label.as_py(), at, v[at]))
                blobs = [pa.array([np.ascontiguousarray(x, dtype).tobytes()], pa.binary()) for x, dtype in zip(held, HELD.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([t[at[0]]]), pa.array([label.as_py()], names.dictionary.type), *blobs], ["t", "label", *HELD])

    return rows.mapInArrow(run, f"t long, label {kind}, " + ", ".join(f"{c} binary" for c in HELD))


def with_marks(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """``rows`` of ``packed`` or ``with_near``, and for each label a mark at the end of each batch: t and label alone."""
    ends = F.explode(F.array(*[F.lit(end - 1).cast("long") for _, end in bounds]))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("t", "label")]
    return rows.unionByName(rows.select("label").distinct().select(ends.alias("t"), "label", *others))


class Batched:
    """A label's part of a window of ``width`` rows, followed by batches: which place is next, and the rows of its window."""

    def __init__(self, width: int, kept: str | None = None):
        self.width = width
        state = json.loads(kept) if kept else {"at": None, "held": [[], [], [], [], []], "axes": 1}
        self.at, self.axes = state["at"], state["axes"]
        self.held = [np.array(x, kind) for x, kind in zip(state["held"], HELD.values(), strict=True)]

    def dump(self) -> str:
        return json.dumps({"at": self.at, "held": [x.tolist() for x in self.held], "axes": self.axes})

    def on(self, stretches: list[list[np.ndarray]], mark: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) that are settled by packed rows, in any order, and a mark that ``mark`` is over; PLACES at most, of one multiple of it."""
        if stretches:
            self.axes = max(1, len(stretches[0][1]) // max(1, len(stretches[0][0])))
        t, v, counts, js, near = (np.concatenate([x, *parts]) for x, parts in zip(self.held, list(zip(*stretches, strict=True)) or [()] * 5, strict=True))
        v, near, first = v.reshape(len(t), self.axes), near.reshape(len(js), self.axes), np.cumsum(counts) - counts
        order = np.argsort(t, kind="stable")
        t, v, counts, first = t[order], v[order], counts[order], first[order]
        if not len(t):
            self.at = self.at if mark is None else mark + 1
            return
        at, upto = int(t[0]) if self.at is None else self.at, int(t[-1]) if mark is None else mark + 1
        # The window of a place has the rows of the last ``width`` places; it changes where one comes or leaves.
        turns = np.unique(np.concatenate([[at], t, t + self.width]))
        turns = turns[(turns >= at) & (turns < upto)]
        ends, low, high = np.append(turns[1:], upto), np.searchsorted(t, turns - self.width, "right"), np.searchsorted(t, turns, "right")
        some = high > low
        turns, ends, low, high = turns[some], ends[some], low[some], high[some]
        rows = lambda a, b: np.repeat(first[a:b] - np.cumsum(counts[a:b]) + counts[a:b], counts[a:b]) + np.arange(int(counts[a:b].sum()))
        step = TOGETHER if len(np.unique(js)) <= MANY else FEWER
        for k in range(0, len(turns), step):
            a, b, part = int(low[k]), int(high[k : k + step][-1]), slice(k, k + step)
            own = rows(a, b)
            score = _scores(v[a:b], counts[a:b], js[own], near[own], low[part] - a, high[part] - a)
            sizes = ends[part] - turns[part]
            places = np.repeat(turns[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            scores, cuts = np.repeat(score, sizes), np.flatnonzero(np.diff(places // PLACES)) + 1
            yield from zip(np.split(places, cuts), np.split(scores, cuts), strict=True)
        left = int(np.searchsorted(t, upto - self.width, "right"))
        own = rows(left, len(t))
        self.at, self.held = upto, [t[left:], v[left:].ravel(), counts[left:], js[own], near[own].ravel()]


def _scores(v: np.ndarray, counts: np.ndarray, js: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A label's score of each window of its rows from ``low`` to before ``high``: rows v with ``counts`` neighbours each, js at near."""
    w, broken = high - low, ~np.isfinite(v).all(axis=1)
    over = lambda x: (lambda total: total[high] - total[low])(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=float)]))
    ids, one, which = np.unique(js, return_index=True, return_inverse=True)
    if not len(ids):
        return w.astype(float)
    uses, xs, v = np.zeros((len(v), len(ids))), near[one], np.where(broken[:, None], 0.0, v)
    uses[np.repeat(np.arange(len(v)), counts), which] = 1.0
    active = (over(uses) > 0.5).astype(float)
    t, a = active.sum(axis=1), (over(distance_block(v, xs)) * active).sum(axis=1)
    c, b = ((active @ distance_block(xs, xs)) * active).sum(axis=1), np.zeros(len(w))
    for lag in range(1, int(w.max())):
        total = np.concatenate([np.zeros(lag + 1), np.cumsum(np.sqrt(((v[lag:] - v[:-lag]) ** 2).sum(axis=1)))])
        b += 2 * (total[high] - total[np.minimum(low + lag, high)])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(a < GUARD, 0.0, w * (1 - (b / (w * w) + c / (t * t)) / (2 * a / (w * t))))
    return np.where(t == 0, w, np.where(over(broken.astype(float)) > 0.5, np.nan, score))


def follow_windows(stream: DataFrame, width: int) -> DataFrame:
    """(label, block, places, scores) of a stream of ``packed`` rows and marks: the score of each label's part of the window of ``width`` rows that ends
    at a place, as bytes for places of one block of PLACES. Where a label has no rows it has no place."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        followed, stretches, mark = Batched(width, state.get[0] if state.exists else None), [], None
        for rows in batches:
            for t, *held in zip(rows["t"], *[rows[c] for c in HELD], strict=True):
                if held[0] is None:
                    mark = t if mark is None else max(mark, t)
                else:
                    stretches.append([np.frombuffer(x, kind) for x, kind in zip(held, HELD.values(), strict=True)])
        found = list(followed.on(stretches, None if mark is None else int(mark)))
        state.update((followed.dump(),))
        yield pd.DataFrame({"label": [key[0]] * len(found), "block": np.array([p[0] // PLACES for p, _ in found], np.int64), "places": [p.astype(np.int64).tobytes() for p, _ in found], "scores": [s.tobytes() for _, s in found]})

    kind = stream.schema["label"].dataType.simpleString()
    return stream.groupBy("label").applyInPandasWithState(step, f"label {kind}, block long, places binary, scores binary", "window string", "append", GroupStateTimeout.NoTimeout)


def drift_of(found: DataFrame, width: int, first: int) -> DataFrame:
    """(t, drift) from the scores of all labels of ``follow_windows``, from the first whole window on."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        places, scores = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("places", np.int64), ("scores", float)))
        low = int(places.min())
        there, total = np.bincount(places - low), np.bincount(places - low, scores)
        t = np.flatnonzero(there) + low
        whole = t >= first + width - 1
        return pa.table({"t": pa.array(t[whole]), "drift": pa.array(total[t - low][whole] / width)})

    return found.groupBy("block").applyInArrow(add, "t long, drift double")
