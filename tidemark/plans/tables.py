"""The driver's tables in the roles of the library: a stream, points, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the stream that the first two models were trained on.
TRAINED = 600
#: Rows of a chunk of the stream.
CHUNK = 500
#: Length of a sliding window, and of a centred mean's arm.
WINDOW, ARM = 30, 7

STREAM_SQL = "stream AS (SELECT event_id AS t, value AS x, event_type AS label FROM events)"
POINTS_SQL = "points AS (SELECT vec_id AS t, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, label): rows in time order, numbered from 0."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x"), F.col("event_type").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, y, v, label): points of the plane with a class."""
    e = F.col("embedding")
    x, y = e[0].cast("double"), e[1].cast("double")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), x.alias("x"), y.alias("y"), F.array(x, y).alias("v"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v, label): vectors of 64 doubles with a class."""
    return axes(spark, sf_dir, 64)


def axes(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    """(t, v, label): the first ``d`` axes of the vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.slice("embedding", 1, d).cast("array<double>").alias("v"), "label")


def models_idx() -> Column:
    """The model of each trained row of the stream: 0 and 1 are used, 2 is not."""
    return F.floor(F.col("t") / (TRAINED // 2)).cast("int")


def r6(x: Column) -> Column:
    """To six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)
