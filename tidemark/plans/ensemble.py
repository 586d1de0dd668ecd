"""Models of stretches of the points, and predictions by a rule over labelled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ensemble as E
from ..operators import mixture as M
from ..operators import prepare as P
from .registry import query
from .tables import CHUNK, POINTS_SQL, points, r6, read, stream

MODELS_SQL = f"""{POINTS_SQL}, mo AS (SELECT t * 5 // (SELECT max(t) + 1 FROM points) AS model_id, avg(x) AS m1, avg(y) AS m2, covar_samp(x, x) AS s11, covar_samp(x, y) AS s12, covar_samp(y, y) AS s22 FROM points WHERE t * 5 < 3 * (SELECT max(t) + 1 FROM points) GROUP BY 1),
dist AS (SELECT t, model_id, (s22 * (x - m1) * (x - m1) - 2 * s12 * (x - m1) * (y - m2) + s11 * (y - m2) * (y - m2)) / (s11 * s22 - s12 * s12) + ln(s11 * s22 - s12 * s12) AS a FROM points, mo)"""


def models(spark, sf_dir):
    """Three models, each of a fifth of the points; the last two fifths have none."""
    rows = P.with_stats(points(spark, sf_dir), (F.max("t") + 1).alias("n"))
    fifth = F.floor(F.col("t") * 5 / F.col("n"))
    return M.moments(rows.withColumn("model_id", fifth).where("model_id < 3"), "model_id")


def found(spark, sf_dir):
    return E.distances(points(spark, sf_dir), models(spark, sf_dir))


@query(f"WITH {MODELS_SQL} SELECT t, model_id, round(a, 6) + 0.0::DOUBLE AS a FROM dist")
def model_distance(spark, sf_dir):
    return found(spark, sf_dir).select("t", "model_id", r6(F.col("a")).alias("a"))


@query(f"WITH {MODELS_SQL}, b AS (SELECT model_id FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY a, model_id) AS r FROM dist) WHERE r = 1) SELECT mo.model_id, round(count(b.model_id) / (SELECT count(*) FROM b), 6) AS share FROM mo LEFT JOIN b ON mo.model_id = b.model_id GROUP BY 1")
def model_pct_min(spark, sf_dir):
    return E.share_by_nearest(found(spark, sf_dir), models(spark, sf_dir)).select("model_id", r6(F.col("share")).alias("share"))


@query(f"WITH {MODELS_SQL}, s AS (SELECT model_id, sum(exp(-a)) AS n FROM dist GROUP BY 1) SELECT model_id, round(n / sum(n) OVER (), 6) AS share FROM s")
def model_pct_linear(spark, sf_dir):
    return E.share_by_proximity(found(spark, sf_dir)).select("model_id", r6(F.col("share")).alias("share"))


@query(f"WITH {MODELS_SQL}, s AS (SELECT model_id, sum(p) AS n FROM (SELECT model_id, exp(-a) / (sum(exp(-a)) OVER (PARTITION BY t) + 1e-4) AS p FROM dist) GROUP BY 1) SELECT model_id, round(n / sum(n) OVER (), 6) AS share FROM s")
def model_pct_softmax(spark, sf_dir):
    return E.share_by_point(found(spark, sf_dir)).select("model_id", r6(F.col("share")).alias("share"))


@query(
    f"""WITH {MODELS_SQL}, q AS (SELECT t, model_id, exp(-a) - max(exp(-a)) OVER (PARTITION BY t) AS q FROM dist), w AS (SELECT t, model_id, exp(q) / sum(exp(q)) OVER (PARTITION BY t) AS w FROM q),
p AS (SELECT t, model_id, 1 / (1 + exp(-(model_id + 1) * x * 10)) AS p FROM points, (SELECT DISTINCT model_id FROM mo WHERE model_id < 2))
SELECT t, c AS class, round(sum(w * CASE WHEN c = 'right' THEN p ELSE 1 - p END), 6) AS proba FROM p JOIN w USING (t, model_id), (VALUES ('right'), ('left')) AS k(c) GROUP BY 1, 2"""
)
def ensemble_pool(spark, sf_dir):
    """Two models that predict a point's side by a rule, and a third without predictions."""
    rows = points(spark, sf_dir).select("t", "x", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("model_id"))
    p = 1 / (1 + F.exp(-(F.col("model_id") + 1) * F.col("x") * 10))
    both = F.array(F.struct(F.lit("right").alias("class"), p.alias("proba")), F.struct(F.lit("left").alias("class"), (1 - p).alias("proba")))
    predictions = rows.select("t", "model_id", F.inline(both))
    return E.pool(predictions, found(spark, sf_dir)).select("t", "class", r6(F.col("proba")).alias("proba"))


JUDGED_SQL = "judged AS (SELECT l.doc_id AS t, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, s, CASE WHEN s >= 0.4 THEN 'good' ELSE 'bad' END AS pred, CASE WHEN s >= 0.4 THEN s ELSE 1 - s END AS score FROM (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS s FROM documents) d JOIN labels l ON d.doc_id = l.doc_id)"


def judged(spark, sf_dir):
    """(t, truth, pred, score): labelled documents judged by a rule on their length."""
    s = F.col("s")
    rows = read(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("s")).join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("t"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(s >= 0.4, "good").otherwise("bad").alias("pred"), F.when(s >= 0.4, s).otherwise(1 - s).alias("score"), "s")


SQUARES_SQL = f"""{JUDGED_SQL}, b AS (SELECT *, least(round_even(score * 10 - 0.5, 0), 9)::INT AS bin FROM judged),
sq AS (SELECT class, bin, kind, other, count(*) AS n, list(t ORDER BY t) AS idx FROM (SELECT t, bin, truth AS class, 'TP' AS kind, truth AS other FROM b WHERE truth = pred UNION ALL SELECT t, bin, truth, 'FN', pred FROM b WHERE truth <> pred UNION ALL SELECT t, bin, pred, 'FP', truth FROM b WHERE truth <> pred) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {SQUARES_SQL} SELECT * FROM sq")
def squares(spark, sf_dir):
    return E.squares(judged(spark, sf_dir))


@query(f"WITH {SQUARES_SQL}, f AS (SELECT class, bin, sum(CASE WHEN kind = 'TP' THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN kind = 'FP' THEN n ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN kind = 'FN' THEN n ELSE 0 END)::BIGINT AS fn FROM sq GROUP BY 1, 2) SELECT class, bin, tp, fp, fn, least(tp, 40) AS shown, greatest(10, max(greatest(tp + fp, fn)) OVER (PARTITION BY class)) AS widest FROM f")
def squares_flat(spark, sf_dir):
    """Bars of each class: right, wrongly given and missed rows, 40 at most shown."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    flat = E.squares(judged(spark, sf_dir)).groupBy("class", "bin").agg(count("TP").alias("tp"), count("FP").alias("fp"), count("FN").alias("fn"))
    widest = F.max(F.greatest(F.col("tp") + F.col("fp"), F.col("fn"))).over(Window.partitionBy("class"))
    return flat.select("*", F.least("tp", F.lit(40).cast("long")).alias("shown"), F.greatest(F.lit(10).cast("long"), widest).alias("widest"))


@query(f"WITH {SQUARES_SQL} SELECT round(sum(n) FILTER (WHERE kind = 'TP') / sum(n) FILTER (WHERE kind <> 'FN'), 6) AS acc FROM sq")
def acc_from_squares(spark, sf_dir):
    n = lambda kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")))
    return E.squares(judged(spark, sf_dir)).agg(r6(n(["TP"]) / n(["TP", "FP"])).alias("acc"))


FOLDS_SQL = f"""{JUDGED_SQL}, folds AS (SELECT fold::INT AS fold, t, (t * 31 + fold * 17 + (t // 10) * 7) % 10 < 7 AS is_train FROM judged, range(9) AS f(fold)),
acc AS (SELECT fold, avg((truth = pred)::INT::DOUBLE) AS acc FROM folds JOIN judged USING (t) WHERE NOT is_train GROUP BY 1)"""


def accuracies(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return E.fold_accuracy(rows, P.fold_flags(rows, 9, 0.7))


@query(f"WITH {FOLDS_SQL} SELECT fold, round(acc, 6) AS acc FROM acc")
def fold_accuracy(spark, sf_dir):
    return accuracies(spark, sf_dir).select("fold", r6(F.col("acc")).alias("acc"))


@query(f"WITH {FOLDS_SQL} SELECT fold, round(acc, 6) AS acc FROM (SELECT *, row_number() OVER (ORDER BY acc, fold) - 1 AS r, count(*) OVER () AS n FROM acc) WHERE r = n // 2")
def median_fold(spark, sf_dir):
    return E.median_fold(accuracies(spark, sf_dir)).select("fold", r6(F.col("acc")).alias("acc"))


@query(f"WITH {FOLDS_SQL} SELECT printf('%.4f', round(acc, 4)) AS acc, count(*) AS n FROM acc GROUP BY 1")
def acc_hist(spark, sf_dir):
    return accuracies(spark, sf_dir).groupBy(F.format_string("%.4f", F.round("acc", 4)).alias("acc")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED_SQL}, r AS (SELECT truth, avg((truth = pred)::INT::DOUBLE) AS recall FROM judged GROUP BY 1) SELECT round(avg(recall), 6) AS balanced FROM r")
def balanced_acc(spark, sf_dir):
    return E.balanced_accuracy(judged(spark, sf_dir), []).select(r6(F.col("balanced")).alias("balanced"))


@query(
    f"WITH {JUDGED_SQL} SELECT round(avg((truth = pred)::INT::DOUBLE), 6) AS acc, count(*) FILTER (WHERE truth = 'good' AND pred = 'good') AS tp, count(*) FILTER (WHERE truth = 'bad' AND pred = 'bad') AS tn, count(*) FILTER (WHERE truth = 'bad' AND pred = 'good') AS fp, count(*) FILTER (WHERE truth = 'good' AND pred = 'bad') AS fn FROM judged"
)
def binary_stat(spark, sf_dir):
    n = lambda truth, pred: F.sum(((F.col("truth") == truth) & (F.col("pred") == pred)).cast("long"))
    return judged(spark, sf_dir).agg(r6(F.avg((F.col("truth") == F.col("pred")).cast("double"))).alias("acc"), n("good", "good").alias("tp"), n("bad", "bad").alias("tn"), n("bad", "good").alias("fp"), n("good", "bad").alias("fn"))


@query("SELECT l_returnflag, round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1")
def r2(spark, sf_dir):
    """Of the price of a line predicted by its quantity."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return E.r_squared(rows, "l_extendedprice", "p", ["l_returnflag"]).select("l_returnflag", r6(F.col("r2")).alias("r2"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS y_true, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents JOIN labels USING (doc_id)")
def basic_stat(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("y_true"), r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_pop("n_chars")).alias("sd"))


@query("SELECT event_type AS label, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events WHERE event_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def selection_stats(spark, sf_dir):
    idx = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("t"))
    return P.select_idx(stream(spark, sf_dir), idx).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))


@query(f"SELECT event_id // {CHUNK} AS chunk_id, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT user_id) AS users, max(event_id) = (SELECT max(event_id) FROM events) AS latest FROM events GROUP BY 1")
def chunk_table(spark, sf_dir):
    rows = P.with_stats(read(spark, sf_dir, "events"), F.max("event_id").alias("end"))
    return rows.groupBy(F.floor(F.col("event_id") / CHUNK).alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"), F.countDistinct("user_id").alias("users"), (F.max("event_id") == F.max("end")).alias("latest")
    )


@query(f"SELECT chunk_id, '{{\"chunk_id\":' || chunk_id || ',\"n\":' || n || ',\"label\":\"' || label || '\"}}' AS json FROM (SELECT event_id // {CHUNK} AS chunk_id, count(*) AS n, max(event_type) AS label FROM events GROUP BY 1)")
def chunk_json(spark, sf_dir):
    rows = stream(spark, sf_dir).groupBy(F.floor(F.col("t") / CHUNK).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))
    return rows.select("chunk_id", F.to_json(F.struct("chunk_id", "n", "label")).alias("json"))


@query(f"WITH {SQUARES_SQL} SELECT class, bin, kind, other, round(len(list_filter(idx, lambda t: t % 3 = 0)) / len(idx), 6) AS proportion FROM sq")
def square_proportions(spark, sf_dir):
    """How much of each square's rows are among some others (every third)."""
    rows = judged(spark, sf_dir)
    found = E.proportions(E.squares(rows), rows.where("t % 3 = 0").select("t"))
    return found.select("class", "bin", "kind", "other", r6(F.col("proportion")).alias("proportion"))
