"""Windows over the stream in time order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import prepare as P
from .registry import query
from .tables import ARM, CHUNK, STREAM_SQL, WINDOW, r6, read, stream


@query(f"WITH {STREAM_SQL}, g AS (SELECT t, CASE WHEN t % 7 IN (0, 1, 2) THEN NULL ELSE x END AS x FROM stream) SELECT t, last_value(x IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS x FROM g")
def ffill(spark, sf_dir):
    rows = stream(spark, sf_dir).select("t", F.when(~(F.col("t") % 7).isin(0, 1, 2), F.col("x")).alias("x"))
    return O.forward_fill(rows, "x", "filled").select("t", F.col("filled").alias("x"))


@query(f"WITH {STREAM_SQL} SELECT t, round(avg(x) OVER (ORDER BY t ROWS BETWEEN {ARM} PRECEDING AND {ARM} FOLLOWING), 6) AS x FROM stream")
def move_avg(spark, sf_dir):
    return O.moving_average(stream(spark, sf_dir), "x", "m", ARM, ARM).select("t", r6(F.col("m")).alias("x"))


@query(f"WITH {STREAM_SQL} SELECT t, round(avg(x) OVER (ORDER BY t ROWS BETWEEN {WINDOW} PRECEDING AND CURRENT ROW), 6) AS x FROM stream")
def move_avg_prev(spark, sf_dir):
    return O.moving_average(stream(spark, sf_dir), "x", "m", WINDOW, 0).select("t", r6(F.col("m")).alias("x"))


@query(f"WITH {STREAM_SQL}, s AS (SELECT t, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM stream) SELECT t, round(avg(x) OVER (ORDER BY t ROWS BETWEEN {ARM} PRECEDING AND {ARM} FOLLOWING), 6) AS origin FROM s")
def origin_series(spark, sf_dir):
    return O.moving_average(P.min_max(stream(spark, sf_dir), "x", "x"), "x", "m", ARM, ARM).select("t", r6(F.col("m")).alias("origin"))


@query(f"WITH {STREAM_SQL} SELECT t, x, lag(x, 1) OVER (ORDER BY t) AS x_1, lag(x, 2) OVER (ORDER BY t) AS x_2 FROM stream")
def lag_features(spark, sf_dir):
    return O.lags(stream(spark, sf_dir), "x", [1, 2]).select("t", "x", "x_1", "x_2")


def _tvd_sql(width: int, bins: int) -> str:
    count = lambda b, frame: f"count(CASE WHEN b = {b} THEN 1 END) OVER (ORDER BY t ROWS BETWEEN {frame})"
    after, before = f"CURRENT ROW AND {width - 1} FOLLOWING", f"{width} PRECEDING AND 1 PRECEDING"
    lost = " + ".join(f"greatest({count(b, before)} - {count(b, after)}, 0)" for b in range(bins))
    return f"WITH {STREAM_SQL}, g AS (SELECT t, CASE WHEN x / 50 BETWEEN -1 AND 6 THEN least(floor((x / 50 + 1) * {bins} / 7), {bins - 1}) END AS b FROM stream), h AS (SELECT t, ({lost}) / {width}::DOUBLE AS tvd, count(*) OVER (ORDER BY t ROWS BETWEEN {after}) AS n FROM g) SELECT t, round(tvd, 6) AS tvd FROM h WHERE t >= {width} AND n = {width}"


@query(_tvd_sql(100, 8))
def tvd(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("x", F.col("x") / 50)
    return O.binned_total_variation(rows, "x", 100, 8, -1.0, 6.0).select("t", r6(F.col("tvd")).alias("tvd"))


@query(
    f"""WITH RECURSIVE {STREAM_SQL}, d AS (SELECT label, t, x - lag(x) OVER w AS d, row_number() OVER w AS i FROM stream WINDOW w AS (PARTITION BY label ORDER BY t)),
c AS (SELECT label, t, i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM d WHERE i = 1
UNION ALL SELECT label, t, i, CASE WHEN u > 60 OR v > 60 THEN 0.0::DOUBLE ELSE u END, CASE WHEN u > 60 OR v > 60 THEN 0.0::DOUBLE ELSE v END
  FROM (SELECT d.label, d.t, d.i, greatest(0.0::DOUBLE, c.up + d.d - 5) AS u, greatest(0.0::DOUBLE, c.down - d.d - 5) AS v FROM c JOIN d ON d.label = c.label AND d.i = c.i + 1) AS s)
SELECT label, t, round(up / 60, 6) AS cusum FROM c"""
)
def cusum(spark, sf_dir):
    return O.cusum(stream(spark, sf_dir), "x", 5.0, 60.0, "label").select("label", "t", r6(F.col("cusum")).alias("cusum"))


@query(f"WITH {STREAM_SQL}, g AS (SELECT label, count(*) / sum(count(*)) OVER () AS share FROM stream GROUP BY 1) SELECT label, round(share, 6) AS share, round(sum(share) OVER (ORDER BY label), 6) AS reach FROM g")
def share_bars(spark, sf_dir):
    """Shares of the labels (a row each) and how far each bar reaches."""
    shares = stream(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    shares = P.with_stats(shares, F.sum("n").alias("all")).select("label", (F.col("n") / F.col("all")).alias("share"))
    return shares.select("label", r6(F.col("share")).alias("share"), r6(F.sum("share").over(Window.orderBy("label"))).alias("reach"))


@query(f"WITH {STREAM_SQL}, n AS (SELECT max(t) AS m FROM stream), p AS (SELECT i::INT AS i, CAST(round(m - i * 37.5 - 3) AS BIGINT) AS t FROM n, range(40) AS r(i)) SELECT i, t, x FROM p JOIN stream USING (t)")
def line_sample(spark, sf_dir):
    """The line at 40 places back from its end, 37.5 rows apart, moved by 3."""
    rows = stream(spark, sf_dir)
    places = rows.agg(F.max("t").alias("m")).select("m", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    places = places.select("i", F.round(F.col("m") - F.col("i") * 37.5 - 3).cast("long").alias("t"))
    return places.join(rows, "t").select("i", "t", "x")


@query(
    f"WITH e AS (SELECT event_id AS t, ts, max(event_id) OVER () AS m FROM events), k AS (SELECT t, ts FROM e WHERE (m - t) % {CHUNK} = 0) SELECT t, CASE WHEN lag(month(ts)) OVER (ORDER BY t) = month(ts) THEN strftime(ts, '%d') ELSE strftime(ts, '%Y-%m-%d') END AS tick FROM k"
)
def ticks(spark, sf_dir):
    """Every 500th row back from the end; the date is shortened where year and month are the one before's."""
    rows = P.with_stats(read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), "ts"), F.max("t").alias("m"))
    rows = rows.where((F.col("m") - F.col("t")) % CHUNK == 0)
    before = F.lag(F.month("ts")).over(Window.orderBy("t"))
    return rows.select("t", F.when(before == F.month("ts"), F.date_format("ts", "dd")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("tick"))


@query(f"WITH {STREAM_SQL}, b AS (SELECT t // {CHUNK} AS batch_id, max(t) + 1 AS density_max FROM stream GROUP BY 1) SELECT batch_id, coalesce(lag(density_max) OVER (ORDER BY batch_id), 0) AS density_min, density_max FROM b")
def batch_bounds(spark, sf_dir):
    ends = stream(spark, sf_dir).groupBy(F.floor(F.col("t") / CHUNK).alias("batch_id")).agg((F.max("t") + 1).alias("density_max"))
    return ends.select("batch_id", F.coalesce(F.lag("density_max").over(Window.orderBy("batch_id")), F.lit(0).cast("long")).alias("density_min"), "density_max")
