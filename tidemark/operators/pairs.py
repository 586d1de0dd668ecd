"""Pairs of rows: distances, nearest neighbours, sums over pairs, overlaps of intervals.

Distances of many rows against many are made block by block: rows are dealt by a hash into blocks (``blocks_of``), each
pair of blocks meets in one task, some strips at a time, and only each row's best of a block (or a sum) leaves it.
Squares of distances come from products of matrices; what may be among the best, or is too close for that, is
taken again by differences, so results are those of differences. Rows are (t, v) with v an array of doubles, or have one value x. Overlaps join
on buckets of the line, so no join is without a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from .ordered import ranked

#: Rows of a block.
BLOCK = 2048
#: Rows of a block of large tables, and from how many blocks of BLOCK rows on they grow: each row is copied once for every block of the other side.
LARGE, FEW = 32_768, 8
#: Distances that a task makes at a time.
STRIP = 1 << 22
#: Squares of distances by products below this share of the rows' own squares are made anew by differences.
CLOSE = 1e-5
#: Rows of each side whose distances leave a task at a time: 25 MB.
GIVEN = 1024


def vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with v, which is x alone where there is no v."""
    return rows if "v" in rows.columns else rows.withColumn("v", F.array(F.col("x").cast("double")))


def matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    """An array column of equally long arrays as rows."""
    values = table.column(name).combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def all_distances(left: DataFrame, right: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(i, j, d) for every row of ``left(i, v)`` and every one of ``right(j, v)``: the matrix itself, block by block.

    Each row is shuffled once, whatever the number of blocks: a block is a partition's one row, and a task reads the two that meet in it.
    It gives their distances by GIVEN rows of each side at a time, however large the blocks are.
    """
    n, m = (blocks_of(left), blocks_of(right)) if n_blocks is None else (n_blocks, n_blocks)
    a, b = _as_rows(left, "i", n), _as_rows(right, "j", m).toDF("j", "w")
    return a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(met, "i long, j long, d double")


def _as_rows(side: DataFrame, name: str, n: int) -> DataFrame:
    """(i, v): blocks of ``side(name, v)`` as one row each, of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        if table.num_rows:
            ids = table.column("i").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([matrix(table).tobytes()])], ["i", "v"])

    schema = pa.schema([("i", pa.int64()), ("v", pa.list_(pa.float64()))])
    side = side.select(F.col(name).cast("long").alias("i"), F.col("v").cast("array<double>").alias("v"))
    return side.repartition(n).mapInArrow(run, "i binary, v binary")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, d) of pairs of blocks(i, v, j, w) of ``_as_rows``."""
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("i", "v", "j", "w")], strict=True):
            i, v, j, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, float) * 2, strict=True))
            ids, values = np.concatenate([i, j]), np.concatenate([v, w])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * (len(values) // len(ids)), pa.int32()), pa.array(values))
            yield from given(iter([pa.RecordBatch.from_arrays([pa.array(ids), lists, pa.array(np.arange(len(ids)) < len(i))], ["i", "v", "_left"])]))


def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, d) of two blocks' rows(i, v, _left), by parts."""
    table = pa.Table.from_batches(batches)
    ids, x, mine = table.column("i").to_numpy(), matrix(table), table.column("_left").to_numpy()
    i, j, x, y = ids[mine], ids[~mine], x[mine], x[~mine]
    for r in range(0, len(i), GIVEN):
        for c in range(0, len(j), GIVEN):
            rows, others = slice(r, r + GIVEN), slice(c, c + GIVEN)
            d = distance_block(x[rows], y[others])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i[rows], d.shape[1])), pa.array(np.tile(j[others], len(d))), pa.array(d.ravel())], ["i", "j", "d"])


def distance_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, some of ``a`` at a time; differences are squared, so equal rows are at 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 18) // max(1, b.size))  # what fits the cache
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None]) ** 2).sum(axis=2))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``distance_block``, by products: to 1e-9 of each distance, and equal rows are at 0."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    mean = b.mean(axis=0)
    x, y = a - mean, b - mean
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if not (np.isfinite(own).all() and np.isfinite(other).all()):
        return distance_block(a, b)
    d = np.concatenate([x, own[:, None], np.ones((len(x), 1))], axis=1) @ np.concatenate([-2 * y, np.ones((len(y), 1)), other[:, None]], axis=1).T
    r, c = np.divmod(np.flatnonzero((d < 3 * CLOSE * own[:, None]).ravel()), len(y))  # close rows have about the same squares
    for at in range(0, len(r), STRIP // 64):
        some = slice(at, at + STRIP // 64)
        d[r[some], c[some]] = ((a[r[some]] - b[c[some]]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def blocks_of(rows: DataFrame) -> int:
    """How many blocks the rows are dealt into: their number decides."""
    n = rows.count()
    return max(1, min(-(-n // BLOCK), max(FEW, -(-n // LARGE))))


def copied(left: DataFrame, right: DataFrame, n_blocks: int | tuple[int, int] | None, i: str, j: str, half: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with _a and _b, a row once for every pair of blocks that it is in; blocks by the rows of each side if no number is given.

    ``half``: of rows against themselves, each two blocks meet once.
    """
    n, m = (blocks_of(left), blocks_of(right)) if n_blocks is None else (n_blocks, n_blocks) if isinstance(n_blocks, int) else n_blocks
    every = lambda low, high: F.explode(F.sequence(low, high))
    a = left.withColumn("_a", F.pmod(F.hash(i), F.lit(n)))
    a = a.withColumn("_b", every(F.col("_a") if half else F.lit(0), F.lit(m - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, if both come from one table
    b = right.withColumn("_b", F.pmod(F.hash(j), F.lit(m)))
    b = b.withColumn("_a", every(F.lit(0), F.col("_b") if half else F.lit(n - 1)))
    return a, b


def dealt(left: DataFrame, right: DataFrame, n_blocks: int | tuple[int, int] | None, i: str, j: str, half: bool = False):
    """Both sides by pairs of blocks, as ``copied``, to be met by a function of two frames."""
    a, b = copied(left, right, n_blocks, i, j, half)
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b"))


def _best(a: np.ndarray, b: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k rows of ``b`` nearest to each of ``a``; ``same``: numbers of both, equal ones don't meet.

    Products give squares of distances up to a bound of their error. The k-th least of the minima of stretches of columns is no
    less than the k-th least of all, so only what is below it or within that error is measured by differences.
    """
    there = [np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (a, b)]  # others are at no distance
    x, y = a[there[0]], b[there[1]]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(x) or not len(y):
        return none
    mean = y.mean(axis=0)
    left, right = x - mean, y - mean
    own, other = (left * left).sum(axis=1), (right * right).sum(axis=1)
    ids = None if same is None else (same[0][there[0]], same[1][there[1]])
    least = k if ids is None else k + int(np.unique(ids[1], return_counts=True)[1].max())
    wide = max(1, min(16, len(y) // max(8 * least, 1)))
    pad = -len(y) % wide  # columns at no distance
    left = np.concatenate([left, np.ones((len(x), 1))], axis=1)
    right = np.concatenate([np.concatenate([-2 * right, other[:, None]], axis=1), np.eye(1, x.shape[1] + 1, x.shape[1]).repeat(pad, 0) * np.finfo(float).max]).T.copy()
    error = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (own + other.max())
    out = []
    step = max(1, STRIP // 2 // len(y))
    space = np.empty((min(step, len(x)), len(y) + pad)) if least < len(y) else None
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        if least >= len(y) or not np.isfinite(error[part]).all():
            r, c = np.divmod(np.arange(len(x[part]) * len(y)), len(y))
        else:
            s = np.matmul(left[part], right, out=space[: len(x[part])])
            low = s.reshape(len(s), wide, -1).min(axis=1)
            bound = np.partition(low, least - 1, axis=1)[:, least - 1] + 2 * error[part]
            r, c = np.divmod(np.flatnonzero((s <= bound[:, None]).ravel()), len(y) + pad)
        r = r + at
        if ids is not None:
            r, c = (v[ids[0][r] != ids[1][c]] for v in (r, c))
        d = np.empty(len(r))
        for i in range(0, len(r), STRIP // 64):
            some = slice(i, i + STRIP // 64)
            d[some] = np.sqrt(((x[r[some]] - y[c[some]]) ** 2).sum(axis=1))
        out.append(_least_of_each(r, c, d, k))
    r, c, d = (np.concatenate([o[i] for o in out]) for i in range(3))
    return there[0][r], there[1][c], d


def _least_of_each(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k least d of each i, ties by j, in that order, and their ranks from 1; what is not finite is left out."""
    ok = np.isfinite(d)
    i, j, d = i[ok], j[ok], d[ok]
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) + 1
    return i[rank <= k], j[rank <= k], d[rank <= k], rank[rank <= k]


#: Candidates that a task ranks at a time.
RANKED = 1 << 20


def nearest(left: DataFrame, right: DataFrame, k: int, n_blocks: int | None = None, itself: bool = True) -> DataFrame:
    """(i, j, d, rank): the k rows of ``right(j, v)`` nearest to each of ``left(i, v)``, ties by j; exact.

    Each block gives its k best of a row as one row with lists, and some rows' lists are ranked together.
    """
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64()), ("rank", pa.int32())])
    lists = pa.schema([("i", pa.int64()), ("js", pa.list_(pa.int64())), ("ds", pa.list_(pa.float64()))])
    left, right = (df.select(F.col(c).cast("long").alias(c), "v") for df, c in ((left, "i"), (right, "j")))
    n, m = (blocks_of(left), blocks_of(right)) if n_blocks is None else (n_blocks, n_blocks)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return (lists if m > 1 else schema).empty_table()
        b = b.sort_by("j")
        ids, js = a.column("i").to_numpy(), b.column("j").to_numpy()
        r, c, d = _best(matrix(a), matrix(b), k, None if itself else (ids, js))
        i, j, d, rank = _least_of_each(ids[r], js[c], d, k)
        if m == 1:
            return pa.table([pa.array(i), pa.array(j), pa.array(d), pa.array(rank, pa.int32())], schema=schema)
        starts = pa.array(np.append(np.flatnonzero(rank == 1), len(i)), pa.int32())
        return pa.table([pa.array(i[rank == 1]), pa.ListArray.from_arrays(starts, pa.array(j)), pa.ListArray.from_arrays(starts, pa.array(d))], schema=lists)

    def rank(table: pa.Table) -> pa.Table:
        js, ds = (table.column(c).combine_chunks() for c in ("js", "ds"))
        i = np.repeat(table.column("i").to_numpy(), js.value_lengths().to_numpy(zero_copy_only=False))
        i, j, d, place = _least_of_each(i, js.flatten().to_numpy(), ds.flatten().to_numpy(), k)
        return pa.table([pa.array(i), pa.array(j), pa.array(d), pa.array(place, pa.int32())], schema=schema)

    met = dealt(left, right, (n, m), "i", "j")
    if m == 1:
        return met.applyInArrow(run, "i long, j long, d double, rank int")
    parts = max(n, left.count() * m * k // RANKED)
    some = F.pmod(F.xxhash64("i"), F.lit(parts)).alias("_part")
    return met.applyInArrow(run, "i long, js array<long>, ds array<double>").groupBy(some).applyInArrow(rank, "i long, j long, d double, rank int")


def _counted(rows: DataFrame, keys: list[str], name: str, block: int) -> DataFrame:
    """(keys, name): into how many blocks each group is dealt."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))


#: Training rows on one axis that are sent to all tasks at most: 16 bytes each.
SENT = 1 << 20


class OnAxis:
    """Training rows (t, x, label) on one axis as sorted arrays of each label, which fit in every task."""

    def __init__(self, trained: DataFrame):
        table = trained.select("label", "x", "t").where("label is not null and x is not null and not isnan(x)").toArrow()
        names, xs, ts = np.array(table.column("label").to_pylist(), object), table.column("x").to_numpy(), table.column("t").to_numpy()
        self.kind, self.sides = table.schema.field("label").type, {}
        for label in set(names.tolist()):
            own = np.flatnonzero(names == label)
            up, down = own[np.lexsort((ts[own], xs[own]))], own[np.lexsort((-ts[own], xs[own]))]
            self.sides[label] = xs[up], ts[up], ts[down]

    def nearest(self, label, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, values and distances of the k nearest of a label to each of ``x``, ties by t; where there are fewer, at no finite distance."""
        value, up, down = self.sides[label]
        place = np.searchsorted(value, x)
        # Above in the order of (x, t); below from the last on, where the later of equal ones stand first.
        where = place[:, None] + np.concatenate([np.arange(k), -1 - np.arange(k)])
        ok = (where >= 0) & (where < len(value))
        where = np.clip(where, 0, len(value) - 1)
        j, y = np.where(np.arange(2 * k) < k, up[where], down[where]), value[where]
        d = np.where(ok, np.abs(x[:, None] - y), np.inf)
        order = np.lexsort((j, d), axis=1)[:, :k]
        return tuple(np.take_along_axis(v, order, 1) for v in (j, y, d))


def _sent_on_axis(rows: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """``nearest_of_label`` on one axis where all training rows fit in every task: two searches in sorted arrays, no shuffle."""
    sent = OnAxis(trained)
    schema = pa.schema([("i", pa.int64()), ("label", sent.kind), ("j", pa.int64()), ("d", pa.float64())])

    def run(batches):
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            x, t = batch.column("x").to_numpy(zero_copy_only=False).astype(float), batch.column("t").to_numpy(zero_copy_only=False)
            for label in set(labels.tolist()) & sent.sides.keys():
                at = np.flatnonzero((labels == label) & np.isfinite(x))
                j, _, d = sent.nearest(label, x[at], k)
                r, c = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(t[at][r]), pa.array([label] * len(r), sent.kind), pa.array(j[r, c]), pa.array(d[r, c])], schema=schema)

    return rows.select("t", "x", "label").mapInArrow(run, f"i long, label {rows.schema['label'].dataType.simpleString()}, j long, d double")


def _ranked_on_axis(rows: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """``nearest_of_label`` on one axis for any number of training rows: they are numbered in order, a row's place among them comes
    from one sort of both sides, and it is joined with the k numbers above and the k below. All shuffles are linear in the rows."""
    trained = keep(trained.where("label is not null and x is not null and not isnan(x)"), "trained")
    both = rows.where("label is not null and x is not null and not isnan(x)").withColumn("_side", F.lit(0)).unionByName(trained.withColumn("_side", F.lit(1)))
    placed = keep(ranked(keep(both, "both"), ["label"], ["x", "_side", "t"], {"_n": (F.col("_side") == 1).cast("long")}), "placed")
    of = lambda df, n: df.select(F.col("label").alias("label"), F.col(n).alias("_at"), F.col("t").alias("j"), F.col("x").alias("_x"))
    up = of(placed.where("_side = 1"), "_n")
    down = of(ranked(trained.withColumn("_u", -F.col("t")), ["label"], ["x", "_u"], {"_n": F.lit(1).cast("long")}), "_n")
    mine = placed.where("_side = 0").select(F.col("t").alias("i"), "label", "x", "_n")
    above = mine.withColumn("_at", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + k))).join(up, ["label", "_at"])
    below = mine.withColumn("_at", F.explode(F.sequence(F.col("_n") - k + 1, F.col("_n")))).join(down, ["label", "_at"])
    found = above.unionByName(below).select("i", "label", "j", F.abs(F.col("x") - F.col("_x")).alias("d"))
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("_rank") <= k).drop("_rank")


def nearest_of_label(rows: DataFrame, trained: DataFrame, k: int, block: int = 0, sent: int = SENT) -> DataFrame:
    """(i, label, j, d): for each row of ``rows(t, v or x, label)`` the k nearest of ``trained(t, v or x, label)`` of its label, ties by t.

    A row of ``trained`` is its own nearest. All are taken where a label has k or fewer. On one axis (x on both sides) they
    stand beside each other in order, so nothing is paired. On several a label's rows of both sides are dealt into blocks
    by their numbers, so a large label is many tasks' and training rows may be as many as they like.
    """
    block = block or BLOCK
    if "x" in rows.columns and "x" in trained.columns:
        rows, trained = (df.select(F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.col("label").alias("label")) for df in (rows, trained))
        return (_sent_on_axis if trained.limit(sent + 1).count() <= sent else _ranked_on_axis)(rows, trained, k)
    # Columns of their own, if both come from one table.
    rows, trained = (vectors(df).select(F.col("t").cast("long").alias("t"), F.col("v").alias("v"), F.col("label").alias("label")) for df in (rows, trained))
    counts = _counted(rows, ["label"], "_n", block).join(_counted(trained, ["label"], "_m", block), "label")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = rows.join(counts, "label").withColumn("_a", F.pmod(F.hash("t"), "_n")).withColumn("_b", every("_m"))
    b = trained.join(counts, "label").withColumn("_b", F.pmod(F.hash("t"), "_m")).withColumn("_a", every("_n"))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("i", pa.int64()), ("label", a.schema.field("label").type), ("j", pa.int64()), ("d", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("t")
        r, c, d = _best(matrix(a), matrix(b), k)
        labels = a.column("label").combine_chunks().take(pa.array(r))
        return pa.table([pa.array(a.column("t").to_numpy()[r]), labels, pa.array(b.column("t").to_numpy()[c]), pa.array(d)], schema=schema)

    kind, keys = rows.schema["label"].dataType.simpleString(), ["label", "_a", "_b"]
    best = a.select("t", "v", *keys).groupBy(*keys).cogroup(b.select("t", "v", *keys).groupBy(*keys)).applyInArrow(run, f"i long, label {kind}, j long, d double")
    if (counts.agg(F.max("_m")).first()[0] or 1) == 1:
        return best  # each row met all training rows of its label in one task
    return best.withColumn("_rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("_rank") <= k).select("i", "label", "j", "d")


def pair_sums(members: DataFrame, keys: list[str], block: int = 0) -> DataFrame:
    """(keys, a, b, c, w, t) of members(keys, side, id, v): sums of distances between side 0 and 1, within 0, within 1 (ordered pairs), and counts.

    A group's members are dealt into blocks; each pair of blocks is a task's, and only its sums leave it.
    """
    block = block or BLOCK
    counts = _counted(members, keys, "_n", block)
    ours = members.join(counts, keys).withColumn("_k", F.pmod(F.hash("side", "id"), "_n").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least(x, "_k").alias("_p"), F.greatest(x, "_k").alias("_q")))
    spread = ours.select(*keys, "side", "v", "_k", F.inline(pairs))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, q = key[len(keys)].as_py(), key[len(keys) + 1].as_py()
        x, side, part = matrix(table), table.column("side").to_numpy(), table.column("_k").to_numpy()
        left, right = part == p, part == q
        one, two = x[left], x[right]
        sums = {(s, u): 0.0 for s in (0, 1) for u in (0, 1)}
        step = max(1, STRIP // max(1, len(two)))
        for at in range(0, len(one), step):
            d, own = distance_block(one[at : at + step], two), side[left][at : at + step]
            for s, u in sums:
                sums[s, u] += d[own == s][:, side[right] == u].sum()
        twice = 1.0 if p == q else 2.0
        a = (sums[0, 1] + sums[1, 0]) * (0.5 if p == q else 1.0)
        n = [float((side[left] == s).sum()) if p == q else 0.0 for s in (0, 1)]
        row = [*key[: len(keys)], *(pa.scalar(float(v)) for v in (a, twice * sums[0, 0], twice * sums[1, 1], *n))]
        return pa.table({name: pa.array([v.as_py()], v.type) for name, v in zip([*keys, "a", "b", "c", "w", "t"], row, strict=True)})

    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)
    parts = spread.groupBy(*keys, "_p", "_q").applyInArrow(run, f"{kinds}, a double, b double, c double, w double, t double")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "abcwt"])


def least_places(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least values of each row; of equal ones the first."""
    if d.shape[1] <= k:
        return np.repeat(np.arange(len(d)), d.shape[1]), np.tile(np.arange(d.shape[1]), len(d))
    chosen = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    for r in np.flatnonzero(chosen.sum(axis=1) > k):
        chosen[r] = False
        chosen[r, np.argsort(d[r], kind="stable")[:k]] = True
    return np.nonzero(chosen)


def merged_intervals(starts: DataFrame, width: int, key: str = "j") -> DataFrame:
    """(key, ..., s, e): the union of [s, s + width - 1] of each key as intervals that don't touch."""
    others = [c for c in starts.columns if c not in (key, "s")]
    order = Window.partitionBy(key).orderBy("s")
    new = (F.col("s") > F.lag("s").over(order) + width - 1).cast("int")
    marked = starts.withColumn("_island", F.sum(F.coalesce(new, F.lit(0))).over(order))
    return marked.groupBy(key, *others, "_island").agg(F.min("s").alias("s"), (F.max("s") + width - 1).alias("e")).drop("_island")


def overlaps(left: DataFrame, right: DataFrame, width: int, by: str = "label") -> DataFrame:
    """Pairs of intervals [s, e] that share a place, of one ``by``: columns of left, and of right with a 2 after them.

    Both are copied into the buckets of ``width`` places that they reach; a pair counts in the bucket in which its later start lies.
    """
    spread = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    other = spread(right).toDF(*[f"{c}2" for c in (*right.columns, "_bucket")])
    joined = spread(left).join(other, (F.col(by) == F.col(f"{by}2")) & (F.col("_bucket") == F.col("_bucket2")))
    ok = (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) & (F.floor(F.greatest("s", "s2") / width) == F.col("_bucket"))
    return joined.where(ok).drop("_bucket", "_bucket2")


def energy(a: Column, b: Column, c: Column) -> Column:
    """1 - (B + C) / 2A of mean distances across and within."""
    return 1 - (b + c) / (2 * a)
