"""Exact quantiles of groups of any size: brackets around a rank that histogram passes narrow.

A pass counts, for each group and rank, the values of its bracket in BINS bins, in partial sums; the bin with the rank is
the next bracket, from the least to the greatest value in it. Once a bracket has ``most`` values or fewer they are
sorted as one list. So no task holds a group, and a pass makes a bracket some hundred times smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import drop, keep

BINS, MOST = 512, 1 << 14


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: Sequence[float], most: int = MOST, bins: int = BINS) -> DataFrame:
    """(key, share, quantile) of each group of ``rows``: between the two values next to its place, as ``percentile``. Nulls and NaN don't count."""
    rows = rows.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    stats = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    if (stats.agg(F.max("n")).first()[0] or 0) <= most:  # a list of each group is as short as the last lists below
        return rows.groupBy("_key").agg(F.percentile("_v", [float(s) for s in shares]).alias("_q")).select(F.col("_key").alias(key), F.posexplode("_q").alias("_i", "quantile")).select(key, F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_i")).alias("share"), "quantile")
    place = (F.col("n") - 1) * F.col("share")
    asked = stats.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.select("_key", "share", "side", place.alias("place"), F.least(F.floor(place) + F.col("side"), F.col("n") - 1).alias("rank"), "n", "low", "high")
    now = keep(asked, "brackets")
    ids = ["_key", "share", "side"]
    while not now.where((F.col("n") > most) & (F.col("low") < F.col("high"))).isEmpty():
        large = (F.col("n") > most) & (F.col("low") < F.col("high"))
        todo = now.where(large).withColumnRenamed("_key", "_k")
        met = rows.join(todo, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("low"), F.col("high")))
        number = F.least(F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = met.groupBy(*ids, "place", "rank", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*ids).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        old, now = now, keep(now.where(~large).unionByName(chosen.select(*ids, "place", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")), "brackets")
        drop(old)
    few = now.where("low < high").withColumnRenamed("_key", "_k")
    lists = rows.join(few, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("low"), F.col("high"))).groupBy("_key", "share", "side", "place", "rank").agg(F.array_sort(F.collect_list("_v")).alias("vs"))
    found = lists.select(*ids, "place", F.get("vs", F.col("rank").cast("int")).alias("v")).unionByName(now.where("low = high").select(*ids, "place", F.col("low").alias("v")))
    low, high = F.max(F.when(F.col("side") == 0, F.col("v"))), F.max(F.when(F.col("side") == 1, F.col("v")))
    part = F.max(F.col("place") - F.floor("place"))
    return found.groupBy("_key", "share").agg(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias("quantile")).withColumnRenamed("_key", key)
