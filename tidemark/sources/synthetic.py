"""Streams of Gaussian mixtures whose shares change at known places, with a label by a noisy border.

Rows are made where they are needed from their number and a seed: no row depends on another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """``n`` rows drawn from (share, mean, covariance) components."""

    n: int
    draws: Sequence[tuple[float, Sequence[float], Sequence[Sequence[float]]]]
    noise: float = 0.0


def _factor(s: Sequence[Sequence[float]]) -> list[list[float]]:
    """The lower Cholesky factor."""
    k = len(s)
    low = [[0.0] * k for _ in range(k)]
    for i in range(k):
        for j in range(i + 1):
            rest = s[i][j] - sum(low[i][m] * low[j][m] for m in range(j))
            low[i][j] = math.sqrt(rest) if i == j else rest / low[j][j]
    return low


def generate(spark: SparkSession, parts: Sequence[Part], label: Callable[[list[Column], Column], Column], seed: int = 42, start: str | None = None, hours: int = 1) -> DataFrame:
    """(t, x1.., y[, timestamp]) of the parts one after another."""
    k, total = len(parts[0].draws[0][1]), sum(p.n for p in parts)
    rows = spark.range(total).withColumnRenamed("id", "t")
    rows = rows.select("t", F.rand(seed).alias("_u"), F.rand(seed + 1).alias("_e"), *[F.randn(seed + 2 + i).alias(f"_z{i}") for i in range(k)])
    z = [F.col(f"_z{i}") for i in range(k)]
    values, noise, at = [F.lit(None).cast("double")] * k, F.lit(0.0), 0
    for part in parts:
        here, passed = (F.col("t") >= at) & (F.col("t") < at + part.n), 0.0
        noise = F.when(here, part.noise).otherwise(noise)
        for share, mean, cov in part.draws:
            low = _factor(cov)
            mine = here & (F.col("_u") >= passed) & (F.col("_u") < passed + share + 1e-12)
            for i in range(k):
                drawn = F.lit(float(mean[i])) + sum((low[i][j] * z[j] for j in range(i + 1)), F.lit(0.0))
                values[i] = F.when(mine, drawn).otherwise(values[i])
            passed += share
        at += part.n
    names = [f"x{i + 1}" for i in range(k)]
    made = rows.select("t", "_e", noise.alias("_n"), *[v.alias(c) for v, c in zip(values, names, strict=True)])
    border = (F.col("_e") * 2 - 1) * F.col("_n")
    out = made.select("t", *names, label([F.col(c) for c in names], border).alias("y"))
    if start is not None:
        out = out.withColumn("timestamp", F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("t") * 3600 * hours), "yyyy-MM-dd HH:mm:ss"))
    return out


_I2, _I3 = [[1, 0], [0, 1]], [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def synthetic(spark: SparkSession, seed: int = 42) -> DataFrame:
    """2500 rows with y, y_2 and y_val: one distribution, its change into a second by tenths, the second, a third, all three."""
    a, b, c = ((-2, 4), _I2), ((0, 0), _I2), ((2, 4), _I2)
    parts = [Part(500, [(1.0, *a)], 0.5), *[Part(100, [(s, *a), (1 - s, *b)], 0.5) for s in (0.9, 0.7, 0.5, 0.3, 0.1)], Part(500, [(1.0, *b)], 0.5), Part(500, [(1.0, *c)], 0.5), Part(500, [(1 / 3, *a), (1 / 3, *b), (1 / 3, *c)])]
    made = generate(spark, parts, lambda x, e: F.struct((x[0] * x[0] - x[1] > e).alias("y"), e.alias("e")), seed)
    x1, x2, y, e = F.col("x1"), F.col("x2"), F.col("y")["y"], F.col("y")["e"]
    # A third class beyond both sides, and a value with noise on the rows that have a noisy border.
    y_2 = F.when((x1 < e - 2) | (x1 > 2 - e), 2).otherwise(y.cast("int"))
    noise = F.when(F.col("t") < 2000, F.randn(seed + 9) * 0.1).otherwise(0.0)
    return made.select("t", "x1", "x2", y.alias("y"), y_2.alias("y_2"), (F.sin(x1 * x1) + F.cos(x2 * x2) + noise).alias("y_val"))


def case1(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Five distributions of 1000 rows, then three of them, of 200 rows each, as a test."""
    d = [((0, 5), [[0.5, 0], [0, 1]]), ((1, 3), [[1, -0.2], [-0.2, 1]]), ((3, 1), [[0.5, 0], [0, 0.5]]), ((5, 3), [[1, 0.2], [0.2, 1]]), ((6, 5), [[1, 0], [0, 2]])]
    parts = [*[Part(1000, [(1.0, *x)], 0.5) for x in d], *[Part(200, [(1.0, *d[k])]) for k in (0, 3, 2)]]
    return generate(spark, parts, lambda x, e: (x[0] - 3) * (x[0] - 3) / 2 + 1 - x[1] > e, seed, "2018-01-01 00:00:00", 2)


def case2(spark: SparkSession, seed: int = 42) -> DataFrame:
    """A distribution that drifts slowly, from row 500 on with two fifths of another."""
    other = ((3, 2, 5), _I3)
    means = [(1, 2, 3), (1, 1.5, 2.5), (0.75, 1.25, 2.25), (0.75, 1, 2)]
    parts = [Part(500, [(1.0, (1, 2, 3), _I3)], 0.3), *[Part(500, [(0.6, m, _I3), (0.4, *other)], 0.3) for m in means]]
    return generate(spark, parts, lambda x, e: 4 + x[0] * x[0] + x[1] * x[1] - x[2] * x[2] > e, seed, "2018-01-01 00:00:00", 2)


def case3(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Two distributions in turn: drift that comes back."""
    a, b = ((2, 2, 6), _I3), ((5.5, 2, 2.5), _I3)
    parts = [Part(500, [(1.0, *a)], 1.0), *[Part(200, [(1.0, *d)], 1.0) for _ in range(5) for d in (b, a)], Part(500, [(1.0, *b)], 1.0)]
    return generate(spark, parts, lambda x, e: x[0] * x[0] + x[2] * x[2] - 38 > e, seed, "2018-01-01 00:00:00", 2)
