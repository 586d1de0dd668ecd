"""Fits and generated streams: rows that SQL can't express, held against brute force or invariants in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import ensemble as E
from ..operators import incremental as I
from ..operators import kernel as K
from ..operators import mixture as M
from ..operators import models as C
from ..operators import prepare as P
from ..operators import views as V
from ..operators import windows as W
from ..sources import synthetic as G
from ..sources.kept import keep
from .registry import query
from .tables import CHUNK, TRAINED, axes, models_idx, points, read, vectors


@query()
def gen_synthetic(spark, sf_dir):
    return G.synthetic(spark)


@query()
def gen_case1(spark, sf_dir):
    return G.case1(spark)


@query()
def gen_case2(spark, sf_dir):
    return G.case2(spark)


@query()
def gen_case3(spark, sf_dir):
    return G.case3(spark)


@query()
def jitter(spark, sf_dir):
    """The stream with noise of a ten-thousandth on its values."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), (F.col("value") + F.randn(2020) * 1e-4).alias("x"))


@query()
def gmm_bic(spark, sf_dir):
    """(key, component, weight, m1, m2): mixtures of the points' classes, each of as many components as its rows ask for."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        comps = I.best_by_bic(rows[["x", "y"]].to_numpy(), 4)
        return pd.DataFrame([(int(rows["label"].iloc[0]), k, c.share, *c.mu) for k, c in enumerate(comps)], columns=["label", "component", "weight", "m1", "m2"])

    return points(spark, sf_dir).groupBy("label").applyInPandas(run, "label int, component int, weight double, m1 double, m2 double")


@query()
def gmm_follow(spark, sf_dir):
    """(label, t, component, uncertain): each event type's rows taken one by one, after a fit of its first hundred."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("t"), F.array("value", F.hour("ts").cast("double")).alias("v"))
    return I.followed(rows, 100, 3)


@query()
def fit_ensemble(spark, sf_dir):
    """(t, model_id, proba): two logistic models of stretches of the stream, each predicting every row."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x"), F.hour("ts").cast("double").alias("hour"), (F.col("event_type") == "click").cast("double").alias("label"))
    assemble = VectorAssembler(inputCols=["x", "hour"], outputCol="features")
    rows = assemble.transform(events)
    found = None
    for model_id in (0, 1):
        own = rows.where((F.col("t") < TRAINED) & (models_idx() == model_id))
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(own)
        one = model.transform(rows).select("t", F.lit(model_id).alias("model_id"), vector_to_array("probability")[1].alias("proba"))
        found = one if found is None else found.union(one)
    return found


@query()
def fold_models(spark, sf_dir):
    """(fold, acc): twenty folds' models of the classes of vectors on eight axes, all fitted in the same passes and judged on what each left out."""
    rows = axes(spark, sf_dir, 8).select("t", F.col("v").alias("f"), F.col("label").cast("string").alias("label"), C.fold_flags(F.col("t"), 20, 0.7).alias("train"))
    rows = keep(rows, "folds")
    made = C.fit(rows, sorted(r["label"] for r in rows.select("label").distinct().collect()))
    judged = E.best_class(C.predict(rows, made, None, "train"), ("t", "fold")).join(rows.select("t", F.col("label").alias("truth")), "t")
    return judged.groupBy("fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))


@query()
def fold_machines(spark, sf_dir):
    """(fold, acc): machines with a radial kernel of three folds of the vectors' classes on eight axes, judged by their probabilities on what each left out."""
    rows = axes(spark, sf_dir, 8).select("t", F.col("v").alias("f"), F.col("label").cast("string").alias("label"), C.fold_flags(F.col("t"), 3, 0.7).alias("train"))
    rows = keep(rows, "folds")
    made = K.fit(rows, sorted(r["label"] for r in rows.select("label").distinct().collect()), landmarks=64)
    judged = E.best_class(C.predict(rows, made, None, "train"), ("t", "fold")).join(rows.select("t", F.col("label").alias("truth")), "t")
    return judged.groupBy("fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))


@query()
def gmm_all_rows(spark, sf_dir):
    """(label, n, mu, log_weight): the mixture of all points that the information criterion asks for, up to four components."""
    rows = keep(points(spark, sf_dir).select("t", "v"), "points")
    best = M.best_by_bic(rows, 4)
    return M.frame(rows, best.parts, best.n).select("label", "n", "mu", "log_weight")


@query()
def gmm_drift(spark, sf_dir):
    """(start, parts, drift): mixtures of windows of half a chunk's length, and the least cost of turning each into the next."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.array("value", F.hour("ts").cast("double")).alias("v"))
    return W.mixture_drift(rows, CHUNK, CHUNK // 2)


@query()
def pca_layout(spark, sf_dir):
    """(t, x, y): the vectors on their two main axes, from one pass of sums over all rows."""
    rows = vectors(spark, sf_dir)
    d = 64

    def sums(batches):
        total, outer, n = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            v = np.stack(b["v"]) if len(b) else np.zeros((0, d))
            total, outer, n = total + v.sum(axis=0), outer + v.T @ v, n + len(v)
        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    parts = rows.select("v").mapInPandas(sums, "n long, total array<double>, outer array<double>").toPandas()
    n = parts["n"].sum()
    mean = np.sum(np.stack(parts["total"]), axis=0) / n
    cov = np.sum(np.stack(parts["outer"]), axis=0).reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    along = lambda k: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, a: x * a), F.lit(-float(mean @ axes[:, k])), lambda s, x: s + x)
    return rows.select("t", along(0).alias("x"), along(1).alias("y"))


@query("WITH l AS (SELECT vec_id AS t, label FROM embeddings WHERE vec_id > (SELECT max(vec_id) FROM embeddings) - 1500) SELECT t, label FROM l ORDER BY md5(t::VARCHAR || ':42'), t LIMIT (SELECT least(count(*) // 2, 500) FROM l)")
def anchor_sample(spark, sf_dir):
    """Rows that hold a later layout in place: of the last 1500 half, 500 at most, by a hash."""
    last = P.last_rows(vectors(spark, sf_dir).select("t", "label"), 1500)
    return V.sampled(last, min(last.count() // 2, 500))
