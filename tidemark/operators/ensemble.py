"""Ensembles of models: distances, pooling of predictions, and their evaluation by folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixture import all_scores, softmax
from .prepare import with_stats


def distances(points: DataFrame, models: DataFrame) -> DataFrame:
    """(t, model_id, a): each point's score by each model's Gaussian, of points(t, v) and models(model_id, mu, s)."""
    return all_scores(points, models, "model_id").withColumnRenamed("value", "a")


def share_by_nearest(found: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, share): of the points nearest to each model; models without any have 0."""
    best = found.groupBy("t").agg(F.min(F.struct("a", "model_id"))["model_id"].alias("model_id"))
    counts = models.select("model_id").join(best.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")), "model_id", "left").fillna(0, ["n"])
    return with_stats(counts, F.sum("n").alias("_all")).select("model_id", (F.col("n") / F.col("_all")).alias("share"))


def share_by_proximity(found: DataFrame) -> DataFrame:
    """(model_id, share): of the summed exp(-a)."""
    sums = found.groupBy("model_id").agg(F.sum(F.exp(-F.col("a"))).alias("n"))
    return with_stats(sums, F.sum("n").alias("_all")).select("model_id", (F.col("n") / F.col("_all")).alias("share"))


def share_by_point(found: DataFrame, small: float = 1e-4) -> DataFrame:
    """(model_id, share): each point's exp(-a) as shares first (``small`` is added to its sum), then summed."""
    p = F.exp(-F.col("a"))
    own = found.select("model_id", (p / (F.sum(p).over(Window.partitionBy("t")) + small)).alias("n"))
    sums = own.groupBy("model_id").agg(F.sum("n").alias("n"))
    return with_stats(sums, F.sum("n").alias("_all")).select("model_id", (F.col("n") / F.col("_all")).alias("share"))


def pool(predictions: DataFrame, found: DataFrame, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """(by, class, proba): predictions(by, model_id, class, proba) weighted by the softmax of exp(-a) over all models.

    A model without a prediction is left out, and the weights of the others stay.
    """
    p = F.exp(-F.col("a"))
    arrays = found.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("model_id", p.alias("p")))).alias("m"))
    weights = arrays.select("t", F.inline(F.arrays_zip(F.col("m.model_id").alias("model_id"), softmax(F.col("m.p")).alias("w"))))
    return predictions.join(weights, ["t", "model_id"]).groupBy(*by, "class").agg(F.sum(F.col("w") * F.col("proba")).alias("proba"))


def best_class(pooled: DataFrame, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """(by, pred, score): the class of most probability, of equal ones the last in order."""
    return pooled.groupBy(*by).agg(F.max(F.struct("proba", "class")).alias("_b")).select(*by, F.col("_b")["class"].alias("pred"), F.col("_b")["proba"].alias("score"))


def proportions(sets: DataFrame, idx: DataFrame) -> DataFrame:
    """``sets(.., idx)`` with proportion, the share of each row's members that are in ``idx(t)``."""
    keys = [c for c in sets.columns if c != "idx"]
    members = sets.select(*keys, F.explode("idx").alias("t")).join(idx.select("t", F.lit(1).alias("_in")).distinct(), "t", "left")
    return sets.join(members.groupBy(*keys).agg((F.count("_in") / F.count(F.lit(1))).alias("proportion")), keys)


def confidence_bin(score: Column) -> Column:
    """The tenth of a score: rounded half to even after moving by half a tenth; 10 counts as 9, as does no score."""
    return F.coalesce(F.least(F.bround(score * 10 - 0.5, 0), F.lit(9)), F.lit(9)).cast("int")


def squares(judged: DataFrame) -> DataFrame:
    """(class, bin, kind, other, n, idx) of judged(t, truth, pred, score).

    A right row counts as TP of its class; a wrong one as FN of the true class and FP of the predicted one.
    """
    binned = judged.withColumn("bin", confidence_bin(F.col("score")))
    right = F.col("truth") == F.col("pred")
    make = lambda c, kind, o: F.struct(F.col(c).alias("class"), F.lit(kind).alias("kind"), F.col(o).alias("other"))
    parts = F.when(right, F.array(make("truth", "TP", "truth"))).otherwise(F.array(make("truth", "FN", "pred"), make("pred", "FP", "truth")))
    rows = binned.select("t", "bin", F.inline(parts))
    return rows.groupBy("class", "bin", "kind", "other").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t")).alias("idx"))


def fold_accuracy(judged: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, acc) over each fold's test rows."""
    tested = folds.where("not is_train").select("fold", "t")
    return tested.join(judged, "t").groupBy("fold").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"))


def median_fold(accuracies: DataFrame) -> DataFrame:
    """The fold in the middle by accuracy (then number): of n, the one at place n // 2 from 0. One row a fold is sorted."""
    placed = accuracies.withColumn("_r", F.row_number().over(Window.orderBy("acc", "fold")) - 1)
    return with_stats(placed, F.count(F.lit(1)).alias("_n")).where(F.col("_r") == F.floor(F.col("_n") / 2)).select("fold", "acc")


def balanced_accuracy(judged: DataFrame, by: list[str]) -> DataFrame:
    """The mean recall of the classes."""
    recall = judged.groupBy(*by, "truth").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced"))


def r_squared(rows: DataFrame, y: str, predicted: str, by: list[str]) -> DataFrame:
    """1 - sum of squared errors over sum of squares about the mean; no line is fitted."""
    error = (F.col(y) - F.col(predicted)) ** 2
    return rows.groupBy(*by).agg((1 - F.sum(error) / (F.var_pop(y) * F.count(y))).alias("r2"))
