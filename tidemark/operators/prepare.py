"""Preparation of a stream: scaling, selection, flags. Whole-table statistics are one row, joined to all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """``df`` with one row of statistics of it beside each of its rows."""
    return df.join(F.broadcast(df.agg(*stats)))


def skip_stride(df: DataFrame, skip: int = 0, step: int = 1, cap: int | None = None, t: str = "t") -> DataFrame:
    """Rows from ``skip`` on, numbered anew, of these the first ``cap``, of these each ``step``-th."""
    kept = df.where(F.col(t) >= skip).withColumn(t, F.col(t) - skip)
    if cap is not None:
        kept = kept.where(F.col(t) < cap)
    return kept.where(F.col(t) % step == 0).withColumn(t, (F.col(t) / step).cast("long"))


def select_idx(df: DataFrame, idx: DataFrame, t: str = "t") -> DataFrame:
    return df.join(idx, t, "left_semi")


def set_labels(old: DataFrame | None, idx: DataFrame, label: int) -> DataFrame:
    """(t, label) with the rows of ``idx(t)`` set to a label, in place of what they had."""
    new = idx.select("t", F.lit(label).alias("label"))
    return new if old is None else old.join(idx.select("t"), "t", "left_anti").union(new)


def permute(df: DataFrame, order: DataFrame, t: str = "t") -> DataFrame:
    """Rows at the positions of ``order(pos, t)``."""
    return order.join(df, t).drop(t).withColumnRenamed("pos", t)


def rename_scaled(df: DataFrame, names: Mapping[str, str], mul: float, scaled: Sequence[str]) -> DataFrame:
    """Columns renamed by ``names`` (others go), and those of ``scaled`` multiplied."""
    return df.select(*[(F.col(a) * mul if b in scaled else F.col(a)).alias(b) for a, b in names.items()])


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """To [0, 1] by the whole column's bounds; 0 where all is equal."""
    low, high = F.col("_low"), F.col("_high")
    return with_stats(df, F.min(column).alias("_low"), F.max(column).alias("_high")).withColumn(name, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)).drop("_low", "_high")


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minus the mean, over the population's deviation, or over 1 where that is 0."""
    wide = with_stats(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return wide.select(*[one(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def hourly(t: Column, start: str = "2000-01-01 00:00:00") -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + t * 3600)


def fold_flags(df: DataFrame, folds: int, rate: float, t: str = "t") -> DataFrame:
    """(fold, t, is_train): a repeatable split of the rows for each fold."""
    draw = (F.col(t) * 31 + F.col("fold") * 17 + F.floor(F.col(t) / 10) * 7) % 10
    return df.select(t, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).select("fold", t, (draw < rate * 10).alias("is_train"))


def last_rows(df: DataFrame, n: int, t: str = "t") -> DataFrame:
    return with_stats(df, F.max(t).alias("_last")).where(F.col(t) > F.col("_last") - n).drop("_last")


def brush(df: DataFrame, low: float, high: float, t: str = "t", snap: float = 0.98) -> DataFrame:
    """Rows whose place on [0, 1] of time is between the ends; all of them if the ends leave out less than 2 %."""
    wide = with_stats(df, F.min(t).alias("_low"), F.max(t).alias("_high"))
    place = (F.col(t) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return wide.where(((place > low) & (place < high)) if high - low <= snap else F.lit(True)).drop("_low", "_high")


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon: a ray to the right crosses an odd number of edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + (spans & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return crossings % 2 == 1
