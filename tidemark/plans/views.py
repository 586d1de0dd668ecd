"""The views' aggregates over points of the plane and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contours as C
from ..operators import prepare as P
from ..operators import views as V
from .registry import query
from .tables import CHUNK, POINTS_SQL, points, r6, read, stream

SCREEN_SQL = f"{POINTS_SQL}, screen AS (SELECT t, label, (x + 1) * 300 AS cx, (y + 1) * 300 AS cy FROM points)"
REACH, FALL, TOP = 2, 0.3, 3.0
OFFSETS_SQL = "off(dx, dy, w) AS (VALUES " + ", ".join(f"({dx}, {dy}, {w!r}::DOUBLE)" for dx, dy, w in V.offsets(REACH, FALL)) + ")"


def screen(spark, sf_dir):
    return points(spark, sf_dir).select("t", "label", ((F.col("x") + 1) * 300).alias("cx"), ((F.col("y") + 1) * 300).alias("cy"))


def grid_sql(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT floor(cx / 10)::INT AS gx, floor(cy / 10)::INT AS gy, count(*) AS n, list(t ORDER BY t) AS ids FROM screen WHERE {where} GROUP BY 1, 2)"


def smooth_sql(name: str, cells: str) -> str:
    return f"{name} AS (SELECT gx, gy, least(sum(d), {TOP}::DOUBLE) AS density FROM (SELECT gx + dx AS gx, gy + dy AS gy, n * w AS d FROM {cells}, off), (SELECT max(gx) AS mx, max(gy) AS my FROM {cells}) WHERE gx >= 0 AND gy >= 0 AND gx <= mx AND gy <= my GROUP BY 1, 2)"


@query(f"WITH {SCREEN_SQL}, {grid_sql('g')} SELECT * FROM g")
def density_grid(spark, sf_dir):
    return V.grid(screen(spark, sf_dir), 10)


@query(f"WITH {SCREEN_SQL}, {OFFSETS_SQL}, {grid_sql('g')}, {smooth_sql('s', 'g')} SELECT gx, gy, round(density, 6) AS density FROM s")
def density_smooth(spark, sf_dir):
    return V.smoothed(V.grid(screen(spark, sf_dir), 10), REACH, FALL, TOP).select("gx", "gy", r6(F.col("density")).alias("density"))


@query(f"WITH {SCREEN_SQL}, {OFFSETS_SQL}, {grid_sql('g0', 't * 5 < 3 * (SELECT count(*) FROM points)')}, {grid_sql('g1', 't * 5 >= 3 * (SELECT count(*) FROM points)')}, {smooth_sql('s0', 'g0')}, {smooth_sql('s1', 'g1')}, d AS (SELECT gx, gy, coalesce(s1.density, 0) - coalesce(s0.density, 0) AS value FROM s0 FULL JOIN s1 USING (gx, gy)) SELECT gx, gy, round(value, 6) + 0.0::DOUBLE AS value, round(pow(abs(value) / max(abs(value)) OVER (), 1.25), 6) AS opacity FROM d")
def density_diff(spark, sf_dir):
    rows = P.with_stats(screen(spark, sf_dir), F.count(F.lit(1)).alias("n"))
    old, new = (V.smoothed(V.grid(rows.where(w), 10), REACH, FALL, TOP) for w in ("t * 5 < n * 3", "t * 5 >= n * 3"))
    return V.difference(old, new).select("gx", "gy", r6(F.col("value")).alias("value"), r6(F.col("opacity")).alias("opacity"))


@query(f"WITH {SCREEN_SQL} SELECT coalesce(label, -1) AS label, coalesce(t % 3, -1) AS part, count(*) AS n, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy FROM screen GROUP BY GROUPING SETS ((), (label), (label, t % 3))")
def centroids(spark, sf_dir):
    """Of all points, of the groups, and of the groups' parts."""
    rows = screen(spark, sf_dir).withColumn("part", F.col("t") % 3)
    return rows.rollup("label", "part").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cx")).alias("cx"), r6(F.avg("cy")).alias("cy")).fillna(-1, ["label", "part"])


@query("WITH r AS (SELECT event_id AS t, value > 60 AS selected, event_type <> 'click' AS shown, min(event_id) OVER () AS a, max(event_id) OVER () + 1 AS b FROM events), s AS (SELECT ((t - a) * 40 // (b - a))::INT AS slice, count(*) AS n, count(*) FILTER (WHERE selected) AS selected, count(*) FILTER (WHERE shown) AS shown FROM r GROUP BY 1) SELECT *, CASE WHEN selected / (n + 1e-5) > 0.95 THEN 3 WHEN selected > 0 THEN 1 ELSE 0 END AS status FROM s")
def axis_flags(spark, sf_dir):
    rows = stream(spark, sf_dir).select("t", (F.col("x") > 60).alias("selected"), (F.col("label") != "click").alias("shown"))
    return V.axis_flags(rows, 40)


#: (first row, place) of the ends of the timeline's regions.
REGIONS = [(0, 0.0), (1000, 0.2), (4000, 0.5), (8000, 0.8), (10**12, 1.0)]


@query("WITH r(a, p, b, q) AS (VALUES " + ", ".join(f"({a}, {p}::DOUBLE, {b}, {q}::DOUBLE)" for (a, p), (b, q) in zip(REGIONS, REGIONS[1:], strict=False)) + "), e AS (SELECT max(event_id) + 1 AS z FROM events) SELECT event_id AS t, a AS region, round(p + (q - p) * (event_id - a) / (least(b, z) - a), 6) AS place FROM events, e JOIN r ON true WHERE event_id >= a AND event_id < b")
def timeline(spark, sf_dir):
    """Rows on a line of regions, each stretched to its own length."""
    rows = P.with_stats(stream(spark, sf_dir), (F.max("t") + 1).alias("z"))
    t, place, region = F.col("t"), F.lit(None), F.lit(None)
    for (a, p), (b, q) in zip(REGIONS, REGIONS[1:], strict=False):
        here = (t >= a) & (t < b)
        place = F.when(here, p + (q - p) * (t - a) / (F.least(F.lit(b), F.col("z")) - a)).otherwise(place)
        region = F.when(here, F.lit(a)).otherwise(region)
    return rows.select("t", region.cast("int").alias("region"), r6(place).alias("place"))


@query("SELECT coalesce(o.t, n.t) AS t, CASE WHEN o.t IS NULL THEN 'enter' WHEN n.t IS NULL THEN 'exit' ELSE 'update' END AS state FROM (SELECT doc_id AS t FROM labels WHERE quality = 1) o FULL JOIN (SELECT doc_id AS t FROM labels WHERE toxic = 1) n ON o.t = n.t")
def enter_exit(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "t")
    return V.enter_exit(rows.where("quality = 1"), rows.where("toxic = 1"))


@query(f"WITH {SCREEN_SQL}, d AS (SELECT t, (cx - 310) ** 2 + (cy - 290) ** 2 AS d2 FROM screen) SELECT t, round(sqrt(d2), 6) AS d FROM d WHERE d2 < 400 ORDER BY d2, t LIMIT 1")
def hover_nn(spark, sf_dir):
    """The point nearest to the pointer, within 20."""
    d2 = (F.col("cx") - 310) ** 2 + (F.col("cy") - 290) ** 2
    return screen(spark, sf_dir).select("t", d2.alias("d2")).where("d2 < 400").orderBy("d2", "t").limit(1).select("t", r6(F.sqrt("d2")).alias("d"))


BOX_SQL = f"{SCREEN_SQL}, box AS (SELECT label, t % 2 AS half, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM screen GROUP BY 1, 2)"


def boxes(spark, sf_dir):
    """A rectangle around each half of each group."""
    rows = screen(spark, sf_dir).groupBy("label", (F.col("t") % 2).alias("half")).agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.withColumn("corners", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


@query(f"WITH {BOX_SQL} SELECT label, half, round((x1 - x0) * (y1 - y0), 4) AS area, round((x0 + x1) / 2, 6) AS mx, round((y0 + y1) / 2, 6) AS my FROM box")
def polygon_area(spark, sf_dir):
    c = F.col("corners")
    centre = lambda axis: F.aggregate(c, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(c)
    return boxes(spark, sf_dir).select("label", "half", F.round(V.polygon_area(c), 4).alias("area"), r6(centre("x")).alias("mx"), r6(centre("y")).alias("my"))


@query(f"WITH {BOX_SQL}, b AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM box), m AS (SELECT o.label, n.label AS partner, ((o.mx - n.mx) ** 2 + (o.my - n.my) ** 2) * greatest(o.a / n.a, n.a / o.a) AS cost FROM b o, b n WHERE o.half = 0 AND n.half = 1) SELECT label, partner, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cost, partner) AS r FROM m) WHERE r = 1")
def polygon_match(spark, sf_dir):
    """Each old outline's new one: the nearest, with unlike areas set back. Outlines travel as one array."""
    rows = boxes(spark, sf_dir).select("label", "half", V.polygon_area(F.col("corners")).alias("a"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    new = rows.where("half = 1").agg(F.collect_list(F.struct("label", "a", "mx", "my")).alias("new"))
    ratio = lambda n: F.greatest(F.col("a") / n["a"], n["a"] / F.col("a"))
    cost = lambda n: ((F.col("mx") - n["mx"]) ** 2 + (F.col("my") - n["my"]) ** 2) * ratio(n)
    best = F.array_min(F.transform("new", lambda n: F.struct(cost(n).alias("cost"), n["label"].alias("partner"))))
    return rows.where("half = 0").join(F.broadcast(new)).select("label", best.alias("best")).select("label", F.col("best")["partner"].alias("partner"), F.round(F.col("best")["cost"], 4).alias("cost"))


@query(f"WITH {BOX_SQL}, b AS (SELECT label * 2 + half AS i, * FROM box) SELECT p.i, q.i AS j, round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)), 4) AS area FROM b p JOIN b q ON p.i < q.i WHERE least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0)")
def polygon_overlap(spark, sf_dir):
    """Which outlines share how much."""
    rows = boxes(spark, sf_dir).select((F.col("label") * 2 + F.col("half")).cast("long").alias("i"), "corners")
    return V.intersections(rows, 100.0).select("i", "j", F.round("area", 4).alias("area"))


@query(f"WITH {SCREEN_SQL}, r AS (SELECT unnest(range(-3, 4)) AS d), k AS (SELECT floor(cx / 10)::INT + x.d AS gx, floor(cy / 10)::INT + y.d AS gy, cx, cy FROM screen, r x, r y) SELECT gx, gy, round(sum(exp(-((cx - (gx + 0.5::DOUBLE) * 10) ** 2 + (cy - (gy + 0.5::DOUBLE) * 10) ** 2) / 800)) / (800 * pi()), 9) AS density FROM k GROUP BY 1, 2")
def kernel_density(spark, sf_dir):
    """Of the points, with a bandwidth of 20, on cells of 10."""
    return V.kernel_density(screen(spark, sf_dir), 10.0, 20.0, 3).select("gx", "gy", F.round("density", 9).alias("density"))


#: Levels of the contour lines, of at most TOP.
LEVELS = [0.5, 1.2, 2.1]


def contour_sql() -> str:
    """Pieces of lines by the squares' cases, and the areas that they go around."""
    side = {0: ("x + (level - v0) / (v1 - v0)", "y"), 1: ("x + 1", "y + (level - v1) / (v2 - v1)"), 2: ("x + (level - v3) / (v2 - v3)", "y + 1"), 3: ("x", "y + (level - v0) / (v3 - v0)")}
    parts = [f"SELECT level, {side[f][0]} AS ax, {side[f][1]} AS ay, {side[t][0]} AS bx, {side[t][1]} AS by_ FROM k WHERE c = {case}" for case, some in C.PIECES.items() for f, t in some]
    return f"""{SCREEN_SQL}, {OFFSETS_SQL}, {grid_sql('g')}, {smooth_sql('s', 'g')}, q AS (SELECT gx - dx AS x, gy - dy AS y, max(CASE WHEN dx = 0 AND dy = 0 THEN density ELSE 0.0 END) AS v0, max(CASE WHEN dx = 1 AND dy = 0 THEN density ELSE 0.0 END) AS v1, max(CASE WHEN dx = 1 AND dy = 1 THEN density ELSE 0.0 END) AS v2, max(CASE WHEN dx = 0 AND dy = 1 THEN density ELSE 0.0 END) AS v3
 FROM s, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy) GROUP BY 1, 2), k AS (SELECT *, (v0 >= level)::INT + 2 * (v1 >= level)::INT + 4 * (v2 >= level)::INT + 8 * (v3 >= level)::INT AS c FROM q, (SELECT unnest({LEVELS}::DOUBLE[]) AS level)), p AS ({" UNION ALL ".join(parts)})"""


@query(f"WITH {contour_sql()} SELECT level, count(*) AS corners, round(sum(ax * by_ - bx * ay) / 2, 4) AS area FROM p GROUP BY 1")
def density_contours(spark, sf_dir):
    """By level, the corners of all rings and the area around which they go, by the corners in turn."""
    found = C.rings(C.pieces(V.smoothed(V.grid(screen(spark, sf_dir), 10), REACH, FALL, TOP), LEVELS))
    c, n = F.col("corners"), F.size("corners")
    cross = lambda i: c[i]["x"] * c[(i + 1) % n]["y"] - c[(i + 1) % n]["x"] * c[i]["y"]
    area = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i)) / 2
    each = found.select("level", n.cast("long").alias("n"), area.alias("a"))
    return each.groupBy("level").agg(F.sum("n").alias("corners"), F.round(F.sum("a"), 4).alias("area"))


@query(f"WITH {SCREEN_SQL} SELECT t, cx, cy FROM screen ORDER BY md5(t::VARCHAR || ':42'), t LIMIT 250")
def haze_sample(spark, sf_dir):
    """Some 250 points that stand for all."""
    return V.sampled(screen(spark, sf_dir), 250).select("t", "cx", "cy")


@query(f"WITH RECURSIVE a AS (SELECT no, CASE WHEN no = 0 THEN NULL WHEN no % 5 = 0 THEN no // 2 ELSE no - 1 END AS parent FROM (SELECT event_id // {CHUNK} AS no FROM events GROUP BY 1)), r AS (SELECT no, no AS root, 0 AS depth FROM a WHERE parent IS NULL UNION ALL SELECT a.no, root, depth + 1 FROM a JOIN r ON a.parent = r.no) SELECT * FROM r")
def provenance(spark, sf_dir):
    """A tree of actions, one a chunk: how deep each lies."""
    no = F.col("no")
    nodes = stream(spark, sf_dir).select(F.floor(F.col("t") / CHUNK).alias("no")).distinct()
    actions = nodes.withColumn("parent", F.when(no == 0, None).when(no % 5 == 0, F.floor(no / 2)).otherwise(no - 1))
    return V.depths(actions)


@query("SELECT event_id AS t, value AS x, event_type AS label, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM events LEFT JOIN labels ON event_id = doc_id")
def row_view(spark, sf_dir):
    """Series that share the row's number, as columns of one row."""
    marks = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "t")
    return stream(spark, sf_dir).join(marks, "t", "left").fillna(-1, ["quality", "toxic"]).select("t", "x", "label", "quality", "toxic")


@query(f"WITH {SCREEN_SQL}, c AS (SELECT label, avg(cx) AS mx, avg(cy) AS my FROM screen GROUP BY 1) SELECT label, t, row_number() OVER (PARTITION BY label ORDER BY round(atan2(cy - my, cx - mx), 9), t) AS place FROM screen JOIN c USING (label)")
def angular_sort(spark, sf_dir):
    """Points of each group in turn around its centre."""
    rows = screen(spark, sf_dir)
    centre = rows.groupBy("label").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    angle = F.round(F.atan2(F.col("cy") - F.col("my"), F.col("cx") - F.col("mx")), 9)
    return rows.join(centre, "label").select("label", "t", F.row_number().over(Window.partitionBy("label").orderBy(angle, "t")).cast("long").alias("place"))
