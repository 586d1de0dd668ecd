"""Drift scores of the event stream against its first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import pairs as J
from ..operators import prepare as P
from ..sources.kept import keep, new_path
from ..streaming import replay, sliding
from .registry import query
from .tables import CHUNK, STREAM_SQL, TRAINED, WINDOW, models_idx, r6, read, stream, vectors

#: Nearest training rows of a row.
K = 5
#: Rows of a batch of the stream, at most.
BATCH = 1 << 20


def near_sql(x: str = "x") -> str:
    return f"""{STREAM_SQL}, tr AS (SELECT t AS j, {x} AS xj, label FROM stream WHERE t < {TRAINED}),
near AS (SELECT i, label, j FROM (SELECT s.t AS i, s.label, j, row_number() OVER (PARTITION BY s.t ORDER BY abs(s.{x} - xj), j) AS r FROM stream s JOIN tr ON tr.label = s.label) WHERE r <= {K})"""


CHUNKS_SQL = f"""{near_sql()},
w AS (SELECT t // {CHUNK} AS chunk_id, label, t, x FROM stream), used AS (SELECT DISTINCT i // {CHUNK} AS chunk_id, near.label, near.j, xj AS x FROM near JOIN tr ON tr.j = near.j),
a AS (SELECT w.chunk_id, w.label, sum(abs(w.x - used.x)) AS a FROM w JOIN used ON w.chunk_id = used.chunk_id AND w.label = used.label GROUP BY 1, 2),
b AS (SELECT p.chunk_id, p.label, sum(abs(p.x - q.x)) AS b FROM w p JOIN w q ON p.chunk_id = q.chunk_id AND p.label = q.label GROUP BY 1, 2),
c AS (SELECT p.chunk_id, p.label, sum(abs(p.x - q.x)) AS c FROM used p JOIN used q ON p.chunk_id = q.chunk_id AND p.label = q.label GROUP BY 1, 2),
nw AS (SELECT chunk_id, label, count(*)::DOUBLE AS w FROM w GROUP BY 1, 2), nt AS (SELECT chunk_id, label, count(*)::DOUBLE AS t FROM used GROUP BY 1, 2),
s AS (SELECT nw.chunk_id, w, CASE WHEN t IS NULL THEN w WHEN a / (w * t) < 1e-4 THEN 0 ELSE w * (1 - (b / (w * w) + c / (t * t)) / (2 * a / (w * t))) END AS d
 FROM nw LEFT JOIN nt USING (chunk_id, label) LEFT JOIN a USING (chunk_id, label) LEFT JOIN b USING (chunk_id, label) LEFT JOIN c USING (chunk_id, label)),
chunk AS (SELECT chunk_id, sum(d) / sum(w) AS drift FROM s GROUP BY 1)"""


def chunked(rows):
    return rows.withColumn("chunk_id", F.floor(F.col("t") / CHUNK))


def trained(rows):
    return rows.where(F.col("t") < TRAINED)


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, round(drift, 6) + 0.0::DOUBLE AS drift FROM chunk")
def drift_chunk(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return D.of_chunks(chunked(rows), trained(rows), K).select("chunk_id", r6(F.col("drift")).alias("drift"))


@query(f"WITH {near_sql()} SELECT i, label, j FROM near")
def knn_label(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return J.nearest_of_label(rows, trained(rows), K).select("i", "label", "j")


SLIDING_SQL = f"""{near_sql()},
iv AS (SELECT j, label, min(i) AS s, max(i) + {WINDOW} - 1 AS e FROM (SELECT *, sum(gap) OVER (PARTITION BY j ORDER BY i) AS island FROM (SELECT j, label, i, CASE WHEN i > lag(i) OVER (PARTITION BY j ORDER BY i) + {WINDOW} - 1 THEN 1 ELSE 0 END AS gap FROM near)) GROUP BY j, label, island),
tv AS (SELECT iv.label, s, e, xj AS x FROM iv JOIN tr USING (j)), wv AS (SELECT label, t AS s, t + {WINDOW} - 1 AS e, x FROM stream),
pa AS (SELECT p.label, greatest(p.s, q.s) AS s, least(p.e, q.e) AS e, abs(p.x - q.x) AS d FROM wv p JOIN tv q ON p.label = q.label AND p.s <= q.e AND q.s <= p.e),
pb AS (SELECT p.label, greatest(p.s, q.s) AS s, least(p.e, q.e) AS e, abs(p.x - q.x) AS d FROM wv p JOIN wv q ON p.label = q.label AND p.s <= q.e AND q.s <= p.e),
pc AS (SELECT p.label, greatest(p.s, q.s) AS s, least(p.e, q.e) AS e, abs(p.x - q.x) AS d FROM tv p JOIN tv q ON p.label = q.label AND p.s <= q.e AND q.s <= p.e),
delta AS ({" UNION ALL ".join(f"SELECT label, s AS t, {', '.join(f'{v} AS {c}' if c == n else f'0.0::DOUBLE AS {c}' for c in 'wnabc')} FROM {src} UNION ALL SELECT label, e + 1, {', '.join(f'-{v}' if c == n else '0.0::DOUBLE' for c in 'wnabc')} FROM {src}" for n, src, v in (("w", "wv", "1.0::DOUBLE"), ("n", "tv", "1.0::DOUBLE"), ("a", "pa", "d"), ("b", "pb", "d"), ("c", "pc", "d")))}
 UNION ALL SELECT l.label, t, 0, 0, 0, 0, 0 FROM stream, (SELECT DISTINCT label FROM stream) l),
g AS (SELECT label, t, {", ".join(f"sum({c}) AS {c}" for c in "wnabc")} FROM delta GROUP BY 1, 2),
r AS (SELECT label, t, {", ".join(f"sum({c}) OVER (PARTITION BY label ORDER BY t) AS {c}" for c in "wnabc")} FROM g),
d AS (SELECT t, CASE WHEN round(w) = 0 OR round(n) = 0 THEN round(w) WHEN a < 1e-4 THEN 0 ELSE w * (1 - (b / (w * w) + c / (n * n)) / (2 * a / (w * n))) END AS d FROM r),
drift AS (SELECT t, sum(d) / {WINDOW} AS drift FROM d WHERE t >= {WINDOW - 1} AND t <= (SELECT max(t) FROM stream) GROUP BY t)"""


@query(f"WITH {SLIDING_SQL} SELECT t, round(drift, 6) + 0.0::DOUBLE AS drift FROM drift")
def drift_sliding(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return D.sliding(rows, trained(rows), WINDOW, K).select("t", r6(F.col("drift")).alias("drift"))


@query(f"WITH {SLIDING_SQL} SELECT t, round(drift, 6) + 0.0::DOUBLE AS drift FROM drift")
def drift_stream(spark, sf_dir):
    """The same from a stream: four batches or, of many rows, a multiple of it, each label's window as state, and a restart from the checkpoint halfway."""
    rows = stream(spark, sf_dir)
    low, high, n = rows.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    parts = 4 * max(1, -(-n // (4 * BATCH)))
    cuts = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    bounds = list(zip(cuts[:-1], cuts[1:], strict=True))
    rows = keep(sliding.packed(rows, trained(rows), K, low, high, parts), "packed")
    marked, source, sink, checkpoint = sliding.with_marks(rows, bounds), new_path(spark, "batches"), new_path(spark, "stretches"), new_path(spark, "checkpoint")
    for some in (bounds[: parts // 2], bounds[parts // 2 :]):
        replay.write_batches(marked, source, some)
        found = sliding.follow_windows(replay.read_batches(spark, source, marked.schema), WINDOW)
        found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sliding.drift_of(spark.read.parquet(sink), WINDOW, low).select("t", r6(F.col("drift")).alias("drift"))


@query(
    f"""WITH {near_sql()}, iv AS (SELECT j, label, min(i) AS s, max(i) + {WINDOW} - 1 AS e FROM (SELECT *, sum(gap) OVER (PARTITION BY j ORDER BY i) AS island FROM (SELECT j, label, i, CASE WHEN i > lag(i) OVER (PARTITION BY j ORDER BY i) + {WINDOW} - 1 THEN 1 ELSE 0 END AS gap FROM near)) GROUP BY j, label, island) SELECT j, label, s, e FROM iv"""
)
def train_active(spark, sf_dir):
    """When each training row is in some window's neighbours."""
    rows = stream(spark, sf_dir)
    near = J.nearest_of_label(rows, trained(rows), K)
    return J.merged_intervals(near.select("j", "label", F.col("i").alias("s")), WINDOW).select("j", "label", "s", "e")


def two_axes_sql() -> str:
    """Chunk drift by value and by hour, in turn."""
    hour = CHUNKS_SQL.replace("value AS x", "hour(ts)::DOUBLE AS x")
    return f"SELECT v.chunk_id, v.drift AS by_value, h.drift AS by_hour FROM (WITH {CHUNKS_SQL} SELECT * FROM chunk) v JOIN (WITH {hour} SELECT * FROM chunk) h USING (chunk_id)"


def by_axis(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    axes = {"by_value": F.col("value"), "by_hour": F.hour("ts").cast("double")}
    found = None
    for name, x in axes.items():
        rows = events.select(F.col("event_id").alias("t"), x.alias("x"), F.col("event_type").alias("label"))
        one = D.of_chunks(chunked(rows), trained(rows), K).withColumnRenamed("drift", name)
        found = one if found is None else found.join(one, "chunk_id")
    return found


@query(f"SELECT event_id AS t, round(greatest(by_value, by_hour), 6) + 0.0::DOUBLE AS ed FROM events JOIN ({two_axes_sql()}) c ON event_id // {CHUNK} = c.chunk_id")
def drift_overall(spark, sf_dir):
    """Each row's chunk's drift, the largest over the attributes."""
    worst = by_axis(spark, sf_dir).select("chunk_id", F.greatest("by_value", "by_hour").alias("ed"))
    return chunked(stream(spark, sf_dir)).join(worst, "chunk_id").select("t", r6(F.col("ed")).alias("ed"))


@query(f"SELECT chunk_id, round(max(d), 6) + 0.0::DOUBLE AS drift FROM (SELECT chunk_id, unnest([by_value, by_hour]) AS d FROM ({two_axes_sql()})) GROUP BY 1")
def chunk_drift(spark, sf_dir):
    return by_axis(spark, sf_dir).select("chunk_id", r6(F.greatest("by_value", "by_hour")).alias("drift"))


@query(f"SELECT chunk_id, round((2 * by_value + by_hour) / 3, 6) + 0.0::DOUBLE AS drift FROM ({two_axes_sql()})")
def weighted_mean(spark, sf_dir):
    """The series of both attributes, with weights 2 and 1."""
    return by_axis(spark, sf_dir).select("chunk_id", r6((2 * F.col("by_value") + F.col("by_hour")) / 3).alias("drift"))


@query(
    f"""WITH {STREAM_SQL}, m AS (SELECT min(t) AS f, max(t) AS l FROM stream), k AS (SELECT t AS u FROM stream, m WHERE t >= f + {WINDOW} AND t + {WINDOW} - 1 <= l),
a AS (SELECT u, sum(abs(p.x - q.x)) / {WINDOW**2} AS a FROM k JOIN stream p ON p.t >= u - {WINDOW} AND p.t < u JOIN stream q ON q.t >= u AND q.t < u + {WINDOW} GROUP BY u),
w AS (SELECT s.t AS e, sum(abs(p.x - q.x)) / {WINDOW**2} AS w FROM stream s JOIN stream p ON p.t > s.t - {WINDOW} AND p.t <= s.t JOIN stream q ON q.t > s.t - {WINDOW} AND q.t <= s.t GROUP BY s.t)
SELECT u AS t, round(CASE WHEN a * {WINDOW**2} < 1e-4 THEN 0 ELSE 1 - (b.w + c.w) / (2 * a) END, 6) + 0.0::DOUBLE AS drift FROM a JOIN w b ON b.e = u - 1 JOIN w c ON c.e = u + {WINDOW} - 1"""
)
def drift_real(spark, sf_dir):
    return D.adjacent(stream(spark, sf_dir), WINDOW).select("t", r6(F.col("drift")).alias("drift"))


@query(f"WITH {STREAM_SQL} SELECT DISTINCT t FROM stream WHERE t < {TRAINED}")
def train_union(spark, sf_dir):
    """Training rows of all used models, once each."""
    rows = stream(spark, sf_dir)
    used = [rows.where(models_idx() == m).select("t") for m in (0, 1)]
    return used[0].union(used[1]).distinct()


@query(
    f"""WITH {STREAM_SQL}, g AS (SELECT (t // {CHUNK}) % 2 AS model_id, label, x FROM stream), r AS (SELECT label, x FROM stream WHERE t < {TRAINED}),
a AS (SELECT model_id, g.label, avg(abs(g.x - r.x)) AS a FROM g JOIN r USING (label) GROUP BY 1, 2), b AS (SELECT p.model_id, p.label, avg(abs(p.x - q.x)) AS b FROM g p JOIN g q ON p.model_id = q.model_id AND p.label = q.label GROUP BY 1, 2),
c AS (SELECT p.label, avg(abs(p.x - q.x)) AS c FROM r p JOIN r q USING (label) GROUP BY 1) SELECT model_id, label, round(1 - (b + c) / (2 * a), 6) + 0.0::DOUBLE AS drift FROM a JOIN b USING (model_id, label) JOIN c USING (label)"""
)
def drift_test(spark, sf_dir):
    """Energy distance of the test rows of each model (by the parity of their chunk) and label to the training rows of the label."""
    rows = stream(spark, sf_dir)
    tested = rows.select((F.floor(F.col("t") / CHUNK) % 2).alias("model_id"), "label", "t", "x")
    return D.between(tested, trained(rows).select("label", "t", "x"), ["model_id"], "label").select("model_id", "label", r6(F.col("drift")).alias("drift"))


# Whole rows of 64 axes: the vectors in the order of their numbers as a stream.

VECTORS_SQL = """stream AS (SELECT vec_id AS t, embedding::DOUBLE[] AS v, label FROM embeddings), span AS (SELECT max(t) + 1 AS n FROM stream), tr AS (SELECT t AS j, v AS vj, label FROM stream, span WHERE t * 5 < n * 2),
near AS (SELECT i, label, j FROM (SELECT s.t AS i, s.label, j, row_number() OVER (PARTITION BY s.t ORDER BY list_distance(s.v, vj), j) AS r FROM stream s JOIN tr ON tr.label = s.label) WHERE r <= 5)"""
#: Length of a window and of a chunk of the vectors.
VECTOR_WINDOW, VECTOR_CHUNK = 20, 50


def _vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    share = P.with_stats(rows, (F.max("t") + 1).alias("n"))
    return rows, share.where(F.col("t") * 5 < F.col("n") * 2).drop("n")


@query(f"WITH {VECTORS_SQL} SELECT i, label, j FROM near")
def knn_label_axes(spark, sf_dir):
    """The nearest of each vector's class among the first two fifths."""
    return J.nearest_of_label(*_vectors(spark, sf_dir), K).select("i", "label", "j")


@query(
    f"""WITH {VECTORS_SQL}, w AS (SELECT t // {VECTOR_CHUNK} AS c, label, v FROM stream), u AS (SELECT DISTINCT i // {VECTOR_CHUNK} AS c, near.label, near.j, vj AS v FROM near JOIN tr ON tr.j = near.j),
a AS (SELECT w.c, w.label, avg(list_distance(w.v, u.v)) AS a FROM w JOIN u ON w.c = u.c AND w.label = u.label GROUP BY 1, 2), b AS (SELECT p.c, p.label, avg(list_distance(p.v, q.v)) AS b FROM w p JOIN w q ON p.c = q.c AND p.label = q.label GROUP BY 1, 2),
e AS (SELECT p.c, p.label, avg(list_distance(p.v, q.v)) AS e FROM u p JOIN u q ON p.c = q.c AND p.label = q.label GROUP BY 1, 2), n AS (SELECT c, label, count(*) AS n FROM w GROUP BY 1, 2)
SELECT n.c AS chunk_id, round(sum(CASE WHEN a IS NULL THEN n WHEN a < 1e-4 THEN 0 ELSE n * (1 - (b + e) / (2 * a)) END) / sum(n), 6) + 0.0::DOUBLE AS drift FROM n LEFT JOIN a USING (c, label) LEFT JOIN b USING (c, label) LEFT JOIN e USING (c, label) GROUP BY 1"""
)
def drift_chunk_axes(spark, sf_dir):
    rows, own = _vectors(spark, sf_dir)
    chunks = rows.withColumn("chunk_id", F.floor(F.col("t") / VECTOR_CHUNK))
    return D.of_chunks(chunks, own, K).select("chunk_id", r6(F.col("drift")).alias("drift"))


@query(
    f"""WITH {VECTORS_SQL}, win AS (SELECT t AS e FROM stream WHERE t >= {VECTOR_WINDOW} - 1), w AS (SELECT e, label, v FROM win JOIN stream s ON s.t > e - {VECTOR_WINDOW} AND s.t <= e),
u AS (SELECT DISTINCT e, near.label, near.j, vj AS v FROM win JOIN near ON i > e - {VECTOR_WINDOW} AND i <= e JOIN tr ON tr.j = near.j),
a AS (SELECT w.e, w.label, sum(list_distance(w.v, u.v)) AS a FROM w JOIN u ON w.e = u.e AND w.label = u.label GROUP BY 1, 2), b AS (SELECT p.e, p.label, sum(list_distance(p.v, q.v)) AS b FROM w p JOIN w q ON p.e = q.e AND p.label = q.label GROUP BY 1, 2),
c AS (SELECT p.e, p.label, sum(list_distance(p.v, q.v)) AS c FROM u p JOIN u q ON p.e = q.e AND p.label = q.label GROUP BY 1, 2), n AS (SELECT e, label, count(*)::DOUBLE AS w FROM w GROUP BY 1, 2), m AS (SELECT e, label, count(*)::DOUBLE AS t FROM u GROUP BY 1, 2)
SELECT n.e AS t, round(sum(CASE WHEN m.t IS NULL THEN w WHEN a < 1e-4 THEN 0 ELSE w * (1 - (b / (w * w) + c / (m.t * m.t)) / (2 * a / (w * m.t))) END) / {VECTOR_WINDOW}, 6) + 0.0::DOUBLE AS drift FROM n LEFT JOIN m USING (e, label) LEFT JOIN a USING (e, label) LEFT JOIN b USING (e, label) LEFT JOIN c USING (e, label) GROUP BY 1"""
)
def drift_sliding_axes(spark, sf_dir):
    return D.sliding(*_vectors(spark, sf_dir), VECTOR_WINDOW, K).select("t", r6(F.col("drift")).alias("drift"))


@query(
    f"""WITH stream AS (SELECT vec_id AS t, embedding::DOUBLE[] AS v FROM embeddings), d AS MATERIALIZED (SELECT p.t AS p, q.t AS q, list_distance(p.v, q.v) AS d FROM stream p JOIN stream q ON abs(p.t - q.t) < 2 * {VECTOR_WINDOW}),
k AS (SELECT t AS u FROM stream WHERE t >= {VECTOR_WINDOW} AND t + {VECTOR_WINDOW} - 1 <= (SELECT max(t) FROM stream)),
s AS (SELECT u, avg(d) FILTER (WHERE p < u AND q >= u) AS a, avg(d) FILTER (WHERE p < u AND q < u) AS b, avg(d) FILTER (WHERE p >= u AND q >= u) AS c FROM k JOIN d ON p >= u - {VECTOR_WINDOW} AND p < u + {VECTOR_WINDOW} AND q >= u - {VECTOR_WINDOW} AND q < u + {VECTOR_WINDOW} GROUP BY u)
SELECT u AS t, round(1 - (b + c) / (2 * a), 6) + 0.0::DOUBLE AS drift FROM s"""
)
def drift_real_axes(spark, sf_dir):
    return D.adjacent(vectors(spark, sf_dir), VECTOR_WINDOW).select("t", r6(F.col("drift")).alias("drift"))


@query(
    f"""WITH {VECTORS_SQL}, g AS (SELECT (t // {VECTOR_CHUNK}) % 2 AS model_id, label, v FROM stream), a AS (SELECT model_id, g.label, avg(list_distance(g.v, vj)) AS a FROM g JOIN tr USING (label) GROUP BY 1, 2),
b AS (SELECT p.model_id, p.label, avg(list_distance(p.v, q.v)) AS b FROM g p JOIN g q ON p.model_id = q.model_id AND p.label = q.label GROUP BY 1, 2), c AS (SELECT p.label, avg(list_distance(p.vj, q.vj)) AS c FROM tr p JOIN tr q USING (label) GROUP BY 1)
SELECT model_id, label, round(1 - (b + c) / (2 * a), 6) + 0.0::DOUBLE AS drift FROM a JOIN b USING (model_id, label) JOIN c USING (label)"""
)
def drift_test_axes(spark, sf_dir):
    rows, own = _vectors(spark, sf_dir)
    tested = rows.withColumn("model_id", F.floor(F.col("t") / VECTOR_CHUNK) % 2)
    return D.between(tested, own, ["model_id"], "label").select("model_id", "label", r6(F.col("drift")).alias("drift"))
