"""Scans, projections, filters and scaling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from .registry import query
from .tables import CHUNK, STREAM_SQL, points, r6, read, stream, vectors


@query("SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value FROM events")
def scan_events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value")


@query("SELECT event_id AS t, value AS x1, hour(ts)::DOUBLE AS x2 FROM events")
def project_attrs(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x1"), F.hour("ts").cast("double").alias("x2"))


@query("SELECT (event_id - 150) // 2 AS t, value AS x FROM events WHERE event_id >= 150 AND (event_id - 150) % 2 = 0")
def skip_stride(spark, sf_dir):
    return P.skip_stride(stream(spark, sf_dir), skip=150, step=2).select("t", "x")


@query("SELECT event_id AS t, value AS x FROM events WHERE event_id IN (SELECT doc_id FROM labels)")
def select_idx(spark, sf_dir):
    idx = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("t"))
    return P.select_idx(stream(spark, sf_dir), idx).select("t", "x")


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT ((event_id * 7919 + 13) % n)::BIGINT AS t, value AS x FROM events, n")
def permute(spark, sf_dir):
    rows = stream(spark, sf_dir)
    order = P.with_stats(rows.select("t"), F.count(F.lit(1)).alias("n")).select(((F.col("t") * 7919 + 13) % F.col("n")).alias("pos"), "t")
    return P.permute(rows, order).select("t", "x")


@query("SELECT event_id AS t, value * 10 AS visibility FROM events")
def rename_mul(spark, sf_dir):
    return P.rename_scaled(read(spark, sf_dir, "events"), {"event_id": "t", "value": "visibility"}, 10.0, ["visibility"])


@query("SELECT event_id AS t, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) + 0.0::DOUBLE AS x FROM events")
def minmax(spark, sf_dir):
    return P.min_max(stream(spark, sf_dir), "x", "x").select("t", r6(F.col("x")).alias("x"))


@query(
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0::DOUBLE AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0::DOUBLE AS l_extendedprice FROM lineitem"
)
def zscore(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    return P.z_scores(rows, columns).select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in columns])


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'not toxic' END AS label FROM labels")
def label_name(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("not toxic").alias("label"))


@query("SELECT event_id AS t, strftime(TIMESTAMP '2000-01-01' + to_hours(event_id), '%Y-%m-%d %H:%M:%S') AS timestamp, 0 AS label FROM events")
def default_ts(spark, sf_dir):
    return stream(spark, sf_dir).select("t", F.date_format(P.hourly(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(0).alias("label"))


@query("SELECT event_id AS t, replace(props, '\"', '''') AS text FROM events")
def quote_norm(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.translate("props", '"', "'").alias("text"))


@query("SELECT fold::INT AS fold, event_id AS t, (event_id * 31 + fold * 17 + (event_id // 10) * 7) % 10 < 7 AS is_train FROM events, range(5) AS f(fold)")
def fold_flags(spark, sf_dir):
    return P.fold_flags(stream(spark, sf_dir), 5, 0.7)


@query(
    "SELECT fold::INT AS fold, (event_id * 31 + fold * 17 + (event_id // 10) * 7) % 10 < 7 AS is_train, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(5) AS f(fold) GROUP BY 1, 2"
)
def fold_split(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return P.fold_flags(rows, 5, 0.7).join(rows, "t").groupBy("fold", "is_train").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"))


@query("SELECT event_id AS t, value AS x FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 365")
def last_n(spark, sf_dir):
    return P.last_rows(stream(spark, sf_dir), 365).select("t", "x")


@query("SELECT (event_id * 3 // (SELECT max(event_id) + 1 FROM events))::INT AS model_id, count(*) AS n FROM events WHERE event_id * 3 // (SELECT max(event_id) + 1 FROM events) < 2 GROUP BY 1")
def active_models(spark, sf_dir):
    """Models trained on a third of the rows each, of which the last isn't used."""
    rows = P.with_stats(stream(spark, sf_dir), (F.max("t") + 1).alias("n"))
    models = rows.groupBy(F.floor(F.col("t") * 3 / F.col("n")).cast("int").alias("model_id")).agg(F.count(F.lit(1)).alias("n"))
    return models.withColumn("use", F.col("model_id") < 2).where("use").select("model_id", "n")


@query("SELECT event_type AS label, round(avg(value - 50) FILTER (WHERE value > 50), 6) AS pos_average FROM events GROUP BY 1")
def pos_average(spark, sf_dir):
    x = F.col("x") - 50
    return stream(spark, sf_dir).groupBy("label").agg(r6(F.avg(F.when(x > 0, x))).alias("pos_average"))


@query("SELECT event_id AS t, value AS x FROM events, (SELECT min(event_id) AS a, max(event_id) AS b FROM events) WHERE (event_id - a) / (b - a) > 0.25 AND (event_id - a) / (b - a) < 0.75")
def time_brush(spark, sf_dir):
    return P.brush(stream(spark, sf_dir), 0.25, 0.75).select("t", "x")


LASSO = [(-0.2, -0.1), (0.15, -0.2), (0.1, 0.05), (0.25, 0.2), (-0.1, 0.15)]
LASSO_SQL = " + ".join(
    f"(CASE WHEN ({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y) AND x < (y - {y1}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1}::DOUBLE THEN 1 ELSE 0 END)"
    for (x1, y1), (x2, y2) in zip(LASSO, [*LASSO[1:], LASSO[0]], strict=True)
)


@query(f"SELECT t, label FROM (SELECT vec_id AS t, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WHERE ({LASSO_SQL}) % 2 = 1")
def lasso(spark, sf_dir):
    return points(spark, sf_dir).where(P.in_polygon(F.col("x"), F.col("y"), LASSO)).select("t", "label")


@query("SELECT event_id AS t, event_type AS label FROM events LEFT JOIN labels ON event_id = doc_id WHERE (toxic = 1 OR event_id >= (SELECT max(event_id) - 1000 FROM events)) AND event_type <> 'click'")
def visible(spark, sf_dir):
    """Rows that are shown or in the latest batch, of components that aren't hidden."""
    shown = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("t"), F.lit(True).alias("shown"))
    rows = P.with_stats(stream(spark, sf_dir), (F.max("t") - 1000).alias("batch"))
    return rows.join(shown, "t", "left").where((F.col("shown") | (F.col("t") >= F.col("batch"))) & ~F.col("label").isin("click")).select("t", "label")


@query("SELECT l_orderkey AS t, l_linenumber AS k, greatest(0, least(1, l_discount * 20))::DOUBLE AS cx, round(300 - l_quantity * 5, 6) AS cy FROM lineitem")
def scale_xy(spark, sf_dir):
    """Values on the screen: one axis clamped, the other turned round."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 20)).alias("cx"), r6(300 - F.col("l_quantity") * 5).alias("cy"))


@query(f"WITH {STREAM_SQL}, b AS (SELECT t // 500 AS batch_id, count(*) AS n, min(t) AS first, max(t) AS last FROM stream GROUP BY 1) SELECT * FROM b")
def batch_assign(spark, sf_dir):
    return stream(spark, sf_dir).groupBy(F.floor(F.col("t") / CHUNK).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("SELECT event_id // 500 AS chunk_id, max(event_id) <= 7000 AS valid FROM events GROUP BY 1")
def chunk_valid(spark, sf_dir):
    return stream(spark, sf_dir).groupBy(F.floor(F.col("t") / CHUNK).alias("chunk_id")).agg((F.max("t") <= 7000).alias("valid"))


@query("SELECT vec_id AS t, round(list_sum(v), 6) + 0.0::DOUBLE AS total, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS dot, round(list_max(v), 6) + 0.0::DOUBLE AS largest, len(list_filter(v, lambda x: x > 0.5)) > 0 AS has_large, list_transform(v[1:3], lambda x: round(x - list_avg(v), 6) + 0.0::DOUBLE) AS centred FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def vector_stats(spark, sf_dir):
    """Of each vector: sum, product with itself, largest part, whether any is large, and the first parts less the mean."""
    v = F.col("v")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size(v)
    rows = vectors(spark, sf_dir)
    return rows.select(
        "t", r6(total).alias("total"), r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("dot"), r6(F.array_max(v)).alias("largest"), F.exists(v, lambda x: x > 0.5).alias("has_large"), F.transform(F.slice(v, 1, 3), lambda x: r6(x - mean)).alias("centred")
    )


@query("SELECT event_id AS t, round(exp(x / 100), 6) AS e, round(ln(x + 1), 6) AS l, round(log2(x + 1), 6) AS l2, round(sqrt(x), 6) AS r, abs(x - 50) AS a, floor(x)::BIGINT AS f, ceil(x)::BIGINT AS c, round(x, 1) AS one, sign(x - 50)::DOUBLE AS s, round(pow(x, 1.5), 3) AS p, floor(x * 1e9) * 1e-9 AS q FROM (SELECT event_id, abs(value) AS x FROM events)")
def math_functions(spark, sf_dir):
    """Elementwise functions of the stream's values, and positions cut to nine places."""
    x = F.col("x")
    rows = stream(spark, sf_dir).select("t", F.abs("x").alias("x"))
    return rows.select(
        "t", F.round(F.exp(x / 100), 6).alias("e"), F.round(F.log(x + 1), 6).alias("l"), F.round(F.log2(x + 1), 6).alias("l2"), F.round(F.sqrt(x), 6).alias("r"), F.abs(x - 50).alias("a"), F.floor(x).alias("f"), F.ceil(x).alias("c"),
        F.round(x, 1).alias("one"), F.signum(x - 50).alias("s"), F.round(F.pow(x, F.lit(1.5)), 3).alias("p"), (F.floor(x * 1e9) * 1e-9).alias("q"),
    )
