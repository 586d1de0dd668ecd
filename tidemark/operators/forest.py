"""Approximate nearest neighbours by a forest of random splits.

Each tree cuts space by hyperplanes halfway between two of its points, until a leaf holds ``LEAF`` rows or fewer.
Trees are grown in rounds: the first from a sample of SAMPLE rows on the driver, each later one within the leaves that
are still too large, from SAMPLE rows of each, in tasks; a round multiplies the leaves by hundreds. Rows meet only
within leaves, so what is shuffled is each row once a tree and its best of each leaf.

Of equal vectors no more than k + 1 can be anybody's neighbours (those of the least numbers), so the others are only
searched for, and a leaf that can't be split is no larger than that. Rows are (i, v) and (j, v), v arrays of doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from .pairs import BLOCK, _best, matrix, nearest

TREES, LEAF, SAMPLE = 10, 256, 16_384


class Tree:
    """Hyperplanes by node; children are nodes, or leaves as negative numbers from -1 on."""

    def __init__(self, normals: np.ndarray, offsets: np.ndarray, children: np.ndarray):
        self.normals, self.offsets, self.children = normals, offsets, children

    @classmethod
    def grown(cls, points: np.ndarray, least: int, rng: np.random.Generator) -> Tree:
        """Cut until a node holds ``least`` points or fewer, or only equal ones."""
        normals, offsets, children, leaves = [], [], [], 0
        waiting = [(np.arange(len(points)), None)]
        while waiting:
            own, above = waiting.pop()
            side = cls._cut(points, own, rng) if len(own) > least else None
            if side is None:
                leaves += 1
                here = -leaves
            else:
                here = len(normals)
                normals.append(side[0])
                offsets.append(side[1])
                children.append([0, 0])
                waiting += [(own[~side[2]], (here, 0)), (own[side[2]], (here, 1))]
            if above is not None:
                children[above[0]][above[1]] = here
        d = points.shape[1]
        return cls(np.array(normals).reshape(-1, d), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2))

    @staticmethod
    def _cut(points: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        """Halfway between two points drawn; of five draws the most even one; none if all drawn are equal."""
        best = None
        for _ in range(5):
            a, b = points[own[rng.integers(len(own), size=2)]]
            if (a == b).all():
                differs = np.flatnonzero((points[own] != a).any(axis=1))
                if not len(differs):
                    return None
                b = points[own[differs[rng.integers(len(differs))]]]
            normal = (b - a) / np.linalg.norm(b - a)
            offset = float(normal @ (a + b) / 2)
            right = points[own] @ normal > offset
            even = min(right.sum(), (~right).sum())
            if even and (best is None or even > best[0]):
                best = (even, normal, offset, right)
        return None if best is None else best[1:]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """Each point's leaf, from 0 on."""
        node = np.full(len(points), 0 if len(self.offsets) else -1, np.int64)
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            right = np.einsum("nd,nd->n", points[open_], self.normals[at]) > self.offsets[at]
            node[open_] = self.children[at, right.astype(int)]
            open_ = open_[node[open_] >= 0]
        return -1 - node

    def packed(self) -> dict[str, list[float]]:
        return {"normals": self.normals.ravel().tolist(), "offsets": self.offsets.tolist(), "children": self.children.ravel().tolist()}

    @classmethod
    def unpacked(cls, row: dict, d: int) -> Tree:
        return cls(np.array(row["normals"], float).reshape(-1, d), np.array(row["offsets"], float), np.array(row["children"], np.int64).reshape(-1, 2))


#: Packed trees of large leaves.
TREE = "normals array<double>, offsets array<double>, children array<long>"


def _placed_by_trees(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """(tree, leaf, id, v): each row once a tree."""

    def run(batches):
        for batch in batches:
            x, n = matrix(pa.table(batch)), batch.num_rows
            leaves = np.concatenate([t.leaf_of(x) for t in trees]) if n else np.zeros(0, np.int64)
            again = pa.array(np.tile(np.arange(n), len(trees)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(trees)), n), pa.int32()), pa.array(leaves.astype(str), pa.string()), batch.column("id").take(again), batch.column("v").take(again)], ["tree", "leaf", "id", "v"])

    return rows.mapInArrow(run, "tree int, leaf string, id long, v array<double>")


def _placed_deeper(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(tree, leaf, id, v) of rows whose leaf has a tree of its own in ``cuts(tree, leaf, parts, ..)``: that leaf with the number of a part."""
    key = ["tree", "leaf", "_part"]
    mine = rows.join(cuts.select("tree", "leaf", "parts"), ["tree", "leaf"]).withColumn("_part", F.pmod(F.hash("id"), "parts"))
    every = cuts.select(*[F.col(c).alias(c) for c in cuts.columns]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(own: pa.Table, cut: pa.Table) -> pa.Table:
        x, row = matrix(own), cut.slice(0, 1).to_pylist()
        if own.num_rows and row:
            deeper = np.char.add(f"{row[0]['leaf']}.", Tree.unpacked(row[0], x.shape[1]).leaf_of(x).astype(str))
            own = own.set_column(own.column_names.index("leaf"), "leaf", pa.array(deeper, pa.string()))
        return own.select(["tree", "leaf", "id", "v"])

    return mine.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(run, "tree int, leaf string, id long, v array<double>")


def _large(rows: DataFrame, leaf: int, depth: int) -> DataFrame:
    """(tree, leaf, n) of the last round's leaves with more than ``leaf`` rows; those of earlier rounds can't be split."""
    new = rows.where(F.size(F.split("leaf", "[.]")) == depth + 1)
    return keep(new.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf), "large")


def in_leaves(left: DataFrame, right: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 3, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides as (tree, leaf, id, v), so that no leaf has more than ``leaf`` rows of ``right``, but for a few that can't be split.

    ``few``: of few rows of ``left``; all rows are placed, but those in leaves without a row of ``left`` are not written or cut further.
    """
    n = right.count()
    rate = min(1.0, 1.5 * sample / max(n, 1))
    drawn = right.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).orderBy(F.xxhash64("id")).limit(sample).select("v").toArrow()
    points = matrix(drawn) if drawn.num_rows else np.zeros((0, 1))
    share = len(points) / max(n, 1)
    grown = [Tree.grown(points, max(1 if share == 1 else 16, int(leaf * share)), np.random.default_rng([seed, k])) for k in range(trees)]
    met = lambda a, b: b.join(F.broadcast(a.select("tree", "leaf").distinct()), ["tree", "leaf"], "left_semi") if few else b
    a = keep(_placed_by_trees(left, grown), "leaves")
    b = keep(met(a, _placed_by_trees(right, grown)), "leaves")
    depth = 0
    while not (large := _large(b, leaf, depth)).isEmpty():
        depth += 1
        rates = large.select("tree", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), (F.lit(sample) / F.col("n")).alias("rate"), "n")
        some = b.join(rates, ["tree", "leaf"]).where(F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

        def grow(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            x, row = matrix(table), table.slice(0, 1).to_pylist()[0]
            least = max(1 if len(x) == row["n"] else 16, int(leaf * len(x) / row["n"]))
            tree = Tree.grown(x, least, np.random.default_rng([seed, row["tree"], *row["leaf"].encode()]))
            return pa.Table.from_pylist([{"tree": row["tree"], "leaf": row["leaf"], "parts": row["parts"], **tree.packed()}], schema=cut)

        cut = pa.schema([("tree", pa.int32()), ("leaf", pa.string()), ("parts", pa.int32()), ("normals", pa.list_(pa.float64())), ("offsets", pa.list_(pa.float64())), ("children", pa.list_(pa.int64()))])
        cuts = keep(some.groupBy("tree", "leaf").applyInArrow(grow, f"tree int, leaf string, parts int, {TREE}").where("size(offsets) > 0"), "cuts")
        names = cuts.select("tree", "leaf")
        deeper = lambda x: x.join(names, ["tree", "leaf"], "left_anti").unionByName(_placed_deeper(x, cuts))
        a = keep(deeper(a), "leaves")
        b = keep(met(a, deeper(b)), "leaves")
    return a, b


def settings(rows: DataFrame, k: int, recall: float = 0.9, leaves: tuple[int, ...] = (32, 64, 128), trees: int = TREES, queries: int = 256) -> DataFrame:
    """(trees, leaf, recall, cost, chosen) of searches within ``rows(i, v)``: measured on ``queries`` rows of the least hashes, whose true neighbours are found exactly.

    The cost is how many distances a row needs on average. One forest for each size of leaves tells the recall of any number of its
    trees: a true neighbour is found from the first tree on in which both rows share a leaf. ``chosen`` is the cheapest setting of
    the recall asked for, or the one of the most recall if none reaches it.
    """
    mine = keep(rows.select(F.col("i").cast("long").alias("id"), "v"), "rows")
    asked = keep(mine.orderBy(F.xxhash64("id"), "id").limit(queries), "asked")
    true = keep(nearest(asked.withColumnRenamed("id", "i"), mine.withColumnRenamed("id", "j"), k, itself=False).select("i", "j"), "true")
    out = None
    for leaf in leaves:
        a, b = in_leaves(asked, mine, trees, leaf, few=True)
        a, b = a.select(F.col("id").alias("i"), "tree", "leaf"), b.select(F.col("id").alias("j"), F.col("tree"), F.col("leaf"))
        first = true.join(a, "i").join(b, ["j", "tree", "leaf"]).groupBy("i", "j").agg(F.min("tree").alias("tree"))
        found = first.groupBy("tree").agg(F.count(F.lit(1)).alias("hits"))
        cost = a.join(b.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), ["tree", "leaf"]).groupBy("tree").agg(F.sum("n").alias("n"))
        per = cost.join(found, "tree", "left").select("tree", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
        upto = Window.orderBy("tree")  # one row a tree
        per = per.select((F.col("tree") + 1).alias("trees"), F.lit(leaf).alias("leaf"), F.sum("hits").over(upto).alias("hits"), F.sum("n").over(upto).alias("n"))
        out = per if out is None else out.unionByName(per)
    pairs, asked_rows = max(true.count(), 1), max(asked.count(), 1)
    out = keep(out.select("trees", "leaf", (F.col("hits") / pairs).alias("recall"), (F.col("n") / asked_rows).alias("cost")), "settings")
    good = F.col("recall") >= recall
    best = out.orderBy(F.desc(good), F.when(good, F.col("cost")), F.desc("recall"), "cost", "leaf").limit(1).select(F.col("trees").alias("_t"), F.col("leaf").alias("_l"))
    return out.join(F.broadcast(best), (F.col("trees") == F.col("_t")) & (F.col("leaf") == F.col("_l")), "left").select("trees", "leaf", "recall", "cost", F.col("_t").isNotNull().alias("chosen"))


def nearest_by_forest(left: DataFrame, right: DataFrame, k: int, itself: bool = True, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = 0.0, queries: int = 256) -> DataFrame:
    """(i, j, d, rank): for each row of ``left(i, v)`` the k rows of ``right(j, v)`` nearest of those that share a leaf with it, ties by j.

    More trees or larger leaves find more of the true neighbours. Rows that find fewer than k, though there are as many, are searched
    for exactly. Without ``itself``, rows of one number don't meet. With a ``recall`` asked for, the leaves are measured on ``queries``
    rows of the least hashes, whose true neighbours are found; if too few share a leaf with them, all rows are searched for exactly.
    """
    left = left.select(F.col("i").cast("long").alias("id"), "v")
    right = right.select(F.col("j").cast("long").alias("id"), "v")
    copies = Window.partitionBy("v").orderBy("id")
    right = keep(right.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy"), "right")
    if recall:
        asked = keep(left.orderBy(F.xxhash64("id"), "id").limit(queries), "asked")
        true = keep(nearest(asked.withColumnRenamed("id", "i"), right.withColumnRenamed("id", "j"), k, itself=itself).select("i", "j"), "true")
        a, b = in_leaves(asked, right, trees, leaf, sample, few=True)
        of = lambda x, name: x.select(F.col("id").alias(name), F.col("tree"), F.col("leaf"))
        met = of(a, "i").join(F.broadcast(true), "i").join(of(b, "j"), ["j", "tree", "leaf"]).select("i", "j").distinct()
        if met.count() < recall * true.count():
            return nearest(left.withColumnRenamed("id", "i"), right.withColumnRenamed("id", "j"), k, itself=itself)
    a, b = in_leaves(left, right, trees, leaf, sample)
    sizes = a.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    key = ["tree", "leaf", "_part"]
    mine = a.join(sizes, ["tree", "leaf"]).withColumn("_part", F.pmod(F.hash("id"), "parts"))
    theirs = b.join(sizes, ["tree", "leaf"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        y = y.sort_by("id")
        i, j = x.column("id").to_numpy(), y.column("id").to_numpy()
        r, c, d = _best(matrix(x), matrix(y), k, None if itself else (i, j))
        return pa.table([pa.array(i[r]), pa.array(j[c]), pa.array(d)], schema=schema)

    found = mine.select(*key, "id", "v").groupBy(*key).cogroup(theirs.select(*key, "id", "v").groupBy(*key)).applyInArrow(run, "i long, j long, d double")
    order = Window.partitionBy("i").orderBy("d", "j")
    found = keep(found.dropDuplicates(["i", "j"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "near")
    full = found.where(F.col("rank") == k).select("i")
    short = keep(left.select(F.col("id").alias("i"), "v").join(full, "i", "left_anti"), "short")
    if short.isEmpty():
        return found
    exact = nearest(short, right.select(F.col("id").alias("j"), "v"), k, itself=itself)
    return found.join(short.select("i"), "i", "left_anti").unionByName(exact)
