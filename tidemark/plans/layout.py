"""Layout quantities on fixed positions (the points' own coordinates)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import pairs as J
from ..operators import prepare as P
from ..operators import quadtree as Q
from ..sources.kept import keep
from .pairs import DIST_SQL, ranked, sides
from .registry import query
from .tables import POINTS_SQL, points, r6, vectors

NEAR = 10
P_SQL = f"""{DIST_SQL}, near AS ({ranked(extra='WHERE i <> j', k=NEAR)}), c AS (SELECT i, j, exp(-2 * d) / sum(exp(-2 * d)) OVER (PARTITION BY i) AS p FROM near),
e AS (SELECT i, j, p / sum(p) OVER () AS p FROM (SELECT i, j, sum(p) AS p FROM (SELECT i, j, p FROM c UNION ALL SELECT j, i, p FROM c) GROUP BY 1, 2)),
pos AS (SELECT vec_id AS t, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
eq AS (SELECT e.*, a.x - b.x AS dx, a.y - b.y AS dy, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS q FROM e JOIN pos a ON i = a.t JOIN pos b ON j = b.t),
att AS (SELECT i, sum(p * q * dx) AS fx, sum(p * q * dy) AS fy FROM eq GROUP BY 1),
allq AS (SELECT a.t AS i, a.x - b.x AS dx, a.y - b.y AS dy, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS q FROM pos a JOIN pos b ON a.t <> b.t), z AS (SELECT sum(q) AS z FROM allq),
rep AS (SELECT i, sum(q * q * dx) / (SELECT z FROM z) AS rx, sum(q * q * dy) / (SELECT z FROM z) AS ry FROM allq GROUP BY 1)"""


def near(spark, sf_dir):
    return J.nearest(*sides(spark, sf_dir), NEAR, itself=False).select("i", "j", "d")


def edges(spark, sf_dir):
    found = keep(near(spark, sf_dir), "near")  # looked at three times
    return L.symmetrized(L.conditional(found, found.select("i").distinct().withColumn("beta", F.lit(2.0))))


def positions(spark, sf_dir):
    return points(spark, sf_dir).select("t", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"))


@query(
    f"""WITH RECURSIVE {DIST_SQL}, near AS ({ranked(extra='WHERE i <> j', k=NEAR)}), l AS (SELECT i, list_transform(ds, lambda x: x - ds[1]) AS ds FROM (SELECT i, list(d ORDER BY d) AS ds FROM near GROUP BY i)),
s AS (SELECT 0 AS k, i, ds, 1.0::DOUBLE AS beta, 0.0::DOUBLE AS low, NULL::DOUBLE AS high FROM l UNION ALL
 SELECT k + 1, i, ds, CASE WHEN up IS NULL THEN beta * 2 ELSE (down + up) / 2 END, down, up FROM (SELECT *, CASE WHEN h > {math.log(5)!r} THEN beta ELSE low END AS down, CASE WHEN h > {math.log(5)!r} THEN high ELSE beta END AS up
  FROM (SELECT *, ln(list_sum(list_transform(ds, lambda x: exp(-beta * x)))) + beta * list_sum(list_transform(ds, lambda x: x * exp(-beta * x))) / list_sum(list_transform(ds, lambda x: exp(-beta * x))) AS h FROM s) WHERE k < 100 AND abs(h - {math.log(5)!r}) > 1e-5))
SELECT i, round(arg_max(beta, k), 4) AS beta FROM s GROUP BY i"""
)
def perplexity(spark, sf_dir):
    """The bandwidths that give each row's neighbours the entropy of five equal ones."""
    return L.bandwidths(near(spark, sf_dir), 5.0).select("i", F.round("beta", 4).alias("beta"))


@query(f"WITH {P_SQL} SELECT i, j, round(p, 9) AS p FROM e")
def p_symmetrize(spark, sf_dir):
    return edges(spark, sf_dir).select("i", "j", F.round("p", 9).alias("p"))


@query(f"WITH {P_SQL} SELECT i, round(fx, 9) + 0.0::DOUBLE AS fx, round(fy, 9) + 0.0::DOUBLE AS fy FROM att")
def tsne_attr_force(spark, sf_dir):
    found = L.attraction(edges(spark, sf_dir), positions(spark, sf_dir))
    return found.select("i", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("fx", "fy")])


@query(f"WITH {P_SQL} SELECT i, round(coalesce(fx, 0) - rx, 9) + 0.0::DOUBLE AS gx, round(coalesce(fy, 0) - ry, 9) + 0.0::DOUBLE AS gy FROM rep LEFT JOIN att USING (i)")
def tsne_gradient(spark, sf_dir):
    found = L.gradient(edges(spark, sf_dir), positions(spark, sf_dir))
    return found.select("i", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("gx", "gy")])


@query(f"WITH {P_SQL} SELECT round(sum(p * ln((p + 1e-12) / (q / z + 1e-12))), 6) AS error FROM eq, z")
def kl_error(spark, sf_dir):
    return L.kl_error(edges(spark, sf_dir), positions(spark, sf_dir)).select(r6(F.col("error")).alias("error"))


@query("SELECT label, count(*) AS n, round(sqrt(count(*)), 6) AS anchor, round(CASE WHEN count(*) < 500 THEN pow(500 / (count(*) / 2), 0.13) ELSE 1 END, 6) AS row_weight FROM embeddings GROUP BY 1")
def anchor_weight(spark, sf_dir):
    """Weights of the components' own anchors and of rows that serve as anchors."""
    n = F.col("n")
    counts = points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", r6(F.sqrt(n)).alias("anchor"), r6(F.when(n < 500, F.pow(500 / (n / 2), F.lit(0.13))).otherwise(1.0)).alias("row_weight"))


@query("SELECT vec_id AS t, [round(embedding[1]::DOUBLE, 4) + 0.0, round(embedding[3]::DOUBLE, 4) + 0.0] AS x, [round(embedding[2]::DOUBLE, 4) + 0.0, round(embedding[4]::DOUBLE, 4) + 0.0] AS y FROM embeddings")
def layout_trace(spark, sf_dir):
    """Where each row lay, step by step."""
    v = F.col("v")
    steps = vectors(spark, sf_dir).select("t", F.posexplode(F.array(F.struct(v[0].alias("x"), v[1].alias("y")), F.struct(v[2].alias("x"), v[3].alias("y")))).alias("step", "p"))
    trace = steps.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("step", (F.round(F.col("p")["x"], 4) + F.lit(0.0)).alias("x"), (F.round(F.col("p")["y"], 4) + F.lit(0.0)).alias("y")))).alias("s"))
    return trace.select("t", F.col("s.x").alias("x"), F.col("s.y").alias("y"))


@query("WITH p AS (SELECT floor(min(embedding[1]::DOUBLE * 10)) AS x0, ceil(max(embedding[1]::DOUBLE * 10)) AS x1, floor(min(embedding[2]::DOUBLE * 10)) AS y0, ceil(max(embedding[2]::DOUBLE * 10)) AS y1 FROM embeddings) SELECT round(x0 - (x1 - x0) / 20, 6) AS x0, round(x1 + (x1 - x0) / 20, 6) AS x1, round(y0 - (y1 - y0) / 10, 6) AS y0, round(y1 + (y1 - y0) / 10, 6) AS y1 FROM p")
def layout_extent(spark, sf_dir):
    ends = positions(spark, sf_dir).agg(*[f(g(c)).cast("double").alias(f"{c}{k}") for c in "xy" for k, f, g in ((0, F.floor, F.min), (1, F.ceil, F.max))])
    wide = lambda c, part: (F.col(f"{c}1") - F.col(f"{c}0")) / part
    return ends.select(*[r6(F.col(f"{c}{k}") + sign * wide(c, part)).alias(f"{c}{k}") for c, part in (("x", 20), ("y", 10)) for k, sign in ((0, -1), (1, 1))])


def kmeans_sql(k: int, rounds: int) -> str:
    parts = [f"{POINTS_SQL}, a0 AS (SELECT t, x, y, (t - (SELECT min(t) FROM points)) * {k} // (SELECT count(*) FROM points) AS cluster FROM points)"]
    for r in range(rounds):
        parts.append(f"m{r} AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM a{r} GROUP BY 1)")
        parts.append(f"a{r + 1} AS (SELECT t, x, y, cluster FROM (SELECT t, x, y, cluster, row_number() OVER (PARTITION BY t ORDER BY (x - cx) ** 2 + (y - cy) ** 2, cluster) AS r FROM points, m{r}) WHERE r = 1)")
    return f"WITH {', '.join(parts)} SELECT t, cluster::INT AS cluster FROM a{rounds}"


@query(kmeans_sql(5, 2))
def kmeans_local(spark, sf_dir):
    """Two rounds from stretches of rows."""
    return L.kmeans(points(spark, sf_dir), 5, 2)


#: Rounds of the layout below.
ROUNDS = 3


@query()
def tsne_layout(spark, sf_dir):
    """The first rounds of the points' layout, each a job over all points, with repulsion by the tree."""
    return L.fitted_in_rounds(vectors(spark, sf_dir), rounds=ROUNDS)


@query(f"WITH {P_SQL} SELECT i, round(sum(q), 6) AS q, round(sum(q * q * dx), 6) + 0.0::DOUBLE AS fx, round(sum(q * q * dy), 6) + 0.0::DOUBLE AS fy FROM allq GROUP BY 1")
def tree_exact(spark, sf_dir):
    """Repulsion by the tree's cells and leaves as tables, with nothing far enough to count as its mean: the exact sums."""
    found = Q.repulsion_by_tree(positions(spark, sf_dir), theta=0.0, leaf=64, sent=0)
    return found.select("i", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("q", "fx", "fy")])


@query(f"WITH {P_SQL} SELECT count(DISTINCT i) AS n, true AS within_a_hundredth FROM allq")
def tree_error(spark, sf_dir):
    """Whether no force by the tree at the usual angle is off the exact one by over a hundredth of their mean."""
    at = positions(spark, sf_dir)
    both = Q.repulsion_by_tree(at).join(L.repulsion(at).toDF("i", "q2", "fx2", "fy2"), "i")
    off, size = F.hypot(F.col("fx") - F.col("fx2"), F.col("fy") - F.col("fy2")), F.hypot("fx2", "fy2")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.max(off) <= 0.01 * F.avg(size)).alias("within_a_hundredth"))


ANCHOR_SQL = f"""{P_SQL}, h AS (SELECT a.t AS a, a.v, p.x, p.y, 1.0::DOUBLE + a.t % 3 AS w FROM v a JOIN pos p USING (t) WHERE a.t % 25 = 0),
hd AS (SELECT m.t AS i, h.a AS j, h.x AS xj, h.y AS yj, h.w, list_distance(m.v, h.v) ** 2 AS d FROM v m, h), hs AS (SELECT *, exp(-0.1 * d) / sum(exp(-0.1 * d)) OVER (PARTITION BY i) * w AS p0 FROM hd),
hw AS (SELECT i, p0 / sum(p0) OVER () AS p, w, pos.x - xj AS dx, pos.y - yj AS dy, 1 / (1 + (pos.x - xj) ** 2 + (pos.y - yj) ** 2) AS q FROM hs JOIN pos ON i = pos.t)"""


@query(f"WITH {ANCHOR_SQL} SELECT i, round(sum((p - q * w / (SELECT sum(q * w) FROM hw)) * q * dx), 9) + 0.0::DOUBLE AS gx, round(sum((p - q * w / (SELECT sum(q * w) FROM hw)) * q * dy), 9) + 0.0::DOUBLE AS gy FROM hw GROUP BY 1")
def anchored_force(spark, sf_dir):
    """Pulls and pushes of weighted anchors, every 25th vector, on all vectors."""
    rows = keep(vectors(spark, sf_dir).select("t", "v").join(positions(spark, sf_dir), "t"), "rows")
    held = rows.where("t % 25 = 0").select(F.col("t").alias("a"), "v", "x", "y", (1.0 + F.col("t") % 3).alias("w"))
    found = L.gradient_of_all_anchors(rows, held, 0.1)
    return found.select("i", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("gx", "gy")])


@query(
    "WITH pos AS (SELECT embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings), e AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM pos), c AS (SELECT level::INT AS level, least(floor((x - x0) / side * pow(2.0, level)), pow(2.0, level) - 1)::BIGINT AS gx, least(floor((y - y0) / side * pow(2.0, level)), pow(2.0, level) - 1)::BIGINT AS gy, x, y FROM pos, e, range(6) AS l(level)) SELECT level, gx, gy, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS x, round(avg(y), 6) + 0.0::DOUBLE AS y FROM c GROUP BY 1, 2, 3"
)
def cell_sums(spark, sf_dir):
    """Points and their means by the cells of a quad-tree's levels."""
    return L.cells(positions(spark, sf_dir), 5).select("level", "gx", "gy", "n", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("WITH p AS (SELECT vec_id AS t, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT t, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0::DOUBLE AS x, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) + 0.0::DOUBLE AS y FROM p")
def layout_scaled(spark, sf_dir):
    """Positions scaled to a mean of 0 and a deviation of 1."""
    return P.z_scores(points(spark, sf_dir).select("t", "x", "y"), ["x", "y"]).select("t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query()
def layout_steps(spark, sf_dir):
    """(t, x, y): a layout of the first four fifths, and where all lie once the others have come; both with all their rounds."""
    rows = P.with_stats(vectors(spark, sf_dir), F.count(F.lit(1)).alias("n"))
    first = keep(L.fitted_in_rounds(rows.where("t * 5 < n * 4").select("t", "v")), "layout")
    return L.continued_in_rounds(rows.select("t", "v", "label"), first)
