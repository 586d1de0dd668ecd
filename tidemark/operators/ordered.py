"""Operators on rows in order, dealt into blocks of the order so that none needs all rows in one task.

Rows are keyed by a dense position ``t``. What reaches over a block's edge is either carried by one row per block or
read from copies of the rows next to the edge.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep

BLOCK = 1 << 14


def in_blocks(df: DataFrame, before: int, after: int, t: str = "t", size: int = BLOCK) -> DataFrame:
    """``df`` with _block and _own: each row in its own block, and copies in the blocks whose rows look at it."""
    first, last = F.floor((F.col(t) - after) / size), F.floor((F.col(t) + before) / size)
    copied = df.withColumn("_block", F.explode(F.sequence(first, last)))
    return copied.withColumn("_own", F.floor(F.col(t) / size) == F.col("_block"))


def framed(df: DataFrame, make, before: int, after: int, t: str = "t", size: int = BLOCK) -> DataFrame:
    """``make(window)`` gives named columns over the rows in order; frames reach ``before`` and ``after`` rows."""
    window = Window.partitionBy("_block").orderBy(t)
    made = in_blocks(df, before, after, t, size).select("*", *make(window))
    return made.where("_own").drop("_block", "_own")


def running_sums(df: DataFrame, values: Mapping[str, str], t: str = "t", by: str | None = None, size: int = BLOCK) -> DataFrame:
    """For each column its sum over all rows up to this one, of each ``by``, under the name given."""
    keys = [by] if by else []
    block = F.floor(F.col(t) / size)
    blocks = df.groupBy(*keys, block.alias("_b")).agg(*[F.sum(c).alias(f"_s_{c}") for c in values])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in values])
    frame = Window.partitionBy(*keys, "_b").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = df.withColumn("_b", block).select("*", *[F.sum(c).over(frame).alias(f"_own_{c}") for c in values])
    return own.join(blocks, [*keys, "_b"]).select(*df.columns, *[(F.col(f"_before_{c}") + F.col(f"_own_{c}")).alias(name) for c, name in values.items()])


def ranked(df: DataFrame, by: list[str], order: list[str], counts: Mapping[str, Column]) -> DataFrame:
    """``df`` with running sums of ``counts`` over the rows of each ``by`` in ``order``, this row included.

    Rows are dealt into ranges of group and order (of equal ones by their places, so many of them are split) and written;
    sums run within a file, and a row for each group and file carries those of the files before.
    """
    keys = [F.col(c) for c in (*by, *order)]
    dealt = df.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    placed = keep(dealt.select("*", *[c.alias(f"_c_{name}") for name, c in counts.items()], F.monotonically_increasing_id().alias("_row")), "ranked")
    placed = placed.withColumn("_file", F.shiftright("_row", 33))
    runs = placed.groupBy(*by, "_file").agg(*[F.sum(f"_c_{name}").alias(f"_s_{name}") for name in counts])
    earlier = Window.partitionBy(*by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*by, "_file", *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in counts])
    own = Window.partitionBy(*by, "_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.select("*", *[F.sum(f"_c_{name}").over(own).alias(f"_own_{name}") for name in counts])
    return placed.join(runs, [*by, "_file"]).select(*df.columns, *[(F.col(f"_before_{name}") + F.col(f"_own_{name}")).alias(name) for name in counts])


def forward_fill(df: DataFrame, value: str, name: str, t: str = "t", size: int = BLOCK) -> DataFrame:
    """The last value that isn't null up to this row."""
    block = F.floor(F.col(t) / size)
    lasts = df.where(F.col(value).isNotNull()).groupBy(block.alias("_b")).agg(F.max_by(value, t).alias("_v"))
    blocks = df.select(block.alias("_b")).distinct().join(lasts, "_b", "left")
    carried = blocks.withColumn("_carry", F.last("_v", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_v")
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_b").orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_b", block).withColumn("_own", own).join(carried, "_b").withColumn(name, F.coalesce("_own", "_carry")).drop("_b", "_own", "_carry")


def moving_average(df: DataFrame, value: str, name: str, before: int, after: int, t: str = "t") -> DataFrame:
    """The mean of the rows from ``before`` earlier to ``after`` later; frames are shorter at the ends."""
    return framed(df, lambda w: [F.avg(value).over(w.rowsBetween(-before, after)).alias(name)], before, after, t)


def lags(df: DataFrame, value: str, steps: list[int], t: str = "t") -> DataFrame:
    return framed(df, lambda w: [F.lag(value, k).over(w).alias(f"{value}_{k}") for k in steps], max(steps), 0, t)


def binned_total_variation(df: DataFrame, value: str, width: int, bins: int, low: float, high: float, t: str = "t") -> DataFrame:
    """(t, tvd): how much of the histogram of the ``width`` rows before t the ``width`` rows from t on lack.

    The bins are equal over [low, high], the last one closed; other values count in none. Both stretches are whole.
    """
    number: Column = F.when(F.col(value).between(low, high), F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)))
    binned = df.select(t, number.alias("_bin"))

    def make(w):
        count = lambda b, frame: F.count(F.when(F.col("_bin") == b, 1)).over(frame)
        after, before = w.rowsBetween(0, width - 1), w.rowsBetween(-width, -1)
        lost = sum((F.greatest(count(b, before) - count(b, after), F.lit(0)) for b in range(bins)), F.lit(0))
        return [(lost / F.lit(width)).alias("tvd"), F.count(F.lit(1)).over(after).alias("_rows")]

    return framed(binned, make, width, width, t).where((F.col(t) >= width) & (F.col("_rows") == width)).select(t, "tvd")


def cusum(df: DataFrame, value: str, slack: float, tolerance: float, key: str, t: str = "t") -> DataFrame:
    """(key, t, cusum): the upward cumulative sum of the steps of ``value`` over ``tolerance``.

    The upward and the downward sum start anew where either passes the tolerance. A recurrence, so each
    series is one task's; series run side by side.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        up = down = 0.0
        out, last = [], None
        for x in rows["v"].tolist():
            step = 0.0 if last is None else x - last
            up, down = (0.0, 0.0) if last is None else (max(0.0, up + step - slack), max(0.0, down - step - slack))
            if up > tolerance or down > tolerance:
                up = down = 0.0
            out.append(up / tolerance)
            last = x
        return pd.DataFrame({"key": rows["key"], "t": rows["t"], "cusum": out})

    rows = df.select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, t long, cusum double").withColumnRenamed("key", key)
