"""Mixtures of windows of a stream, and what it costs to turn each window's into the next one's."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep
from . import incremental as I

#: Parts below this share are left out.
LEAST_SHARE = 1e-3
#: Windows that are fitted together.
TOGETHER = 32


def window_mixtures(rows: DataFrame, width: int, stride: int, most: int = 3) -> DataFrame:
    """(start, parts) of rows(t, v): the parts of the mixture of each whole window of ``width`` rows that starts at a multiple of ``stride``, as JSON.

    A stretch of windows is a task's, and all its windows are fitted together; a row is copied only to the stretches that it is in.
    """
    last = rows.agg(F.max("t").alias("_last"))
    first = F.greatest(F.lit(0), F.floor((F.col("t") - width) / stride) + 1)
    # Those that end after the last row are left out.
    upto = F.least(F.floor(F.col("t") / stride), F.floor((F.col("_last") + 1 - width) / stride))
    spread = rows.where("t is not null").join(F.broadcast(last)).withColumn("_from", first).withColumn("_upto", upto).where("_from <= _upto")
    spread = spread.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_from") / TOGETHER), F.floor(F.col("_upto") / TOGETHER))))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t, x = part["t"].to_numpy(), np.stack(part["v"])
        starts = [k * stride for k in range(max(int(part["_from"].min()), key[0] * TOGETHER), min(int(part["_upto"].max()), key[0] * TOGETHER + TOGETHER - 1) + 1)]
        windows = [x[np.searchsorted(t, s) : np.searchsorted(t, s + width)] for s in starts]
        there = [k for k, w in enumerate(windows) if len(w)]
        found = [[c for c in parts if c.share > LEAST_SHARE] for parts in I.best_of_many([windows[k] for k in there], most)]
        return pd.DataFrame({"start": [starts[k] for k in there], "parts": [json.dumps([[c.share, c.mu.tolist(), c.s.tolist()] for c in parts]) for parts in found]})

    return spread.select("_part", "_from", "_upto", "t", "v").groupBy("_part").applyInPandas(fit, "start long, parts string")


def mixture_drift(rows: DataFrame, width: int, stride: int, most: int = 3) -> DataFrame:
    """(start, parts, drift): the number of each window's parts, and the least cost of moving their shares to the parts of the window before."""
    found = keep(window_mixtures(rows, width, stride, most), "mixtures")  # both sides of a join read them
    # Each window meets the one before by its start, without a window over all rows.
    before = found.select((F.col("start") + stride).alias("start"), F.col("parts").alias("_before"))
    joined = found.join(before, "start", "left")

    @F.pandas_udf("double")
    def cost(now: pd.Series, earlier: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(now, earlier, strict=True):
            if b is None:
                out.append(0.0)
                continue
            p, q = ([I.Part.of(mu, s, share, 1.0) for share, mu, s in json.loads(x)] for x in (b, a))
            far = np.array([[I.mean_distance(x, y) for y in q] for x in p])
            out.append(I.transport(far, np.array([c.share for c in p]), np.array([c.share for c in q])))
        return pd.Series(out, dtype=float)

    return joined.select("start", F.size(F.from_json("parts", "array<string>")).alias("parts"), cost("parts", "_before").alias("drift"))
