"""Replays of a table as a stream of batches, and state that follows it.

A batch is a folder's file; Structured Streaming takes one file a trigger, in the order of their numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import incremental as I


def write_batches(rows: DataFrame, folder: str, bounds: Sequence[tuple[int, int]], t: str = "t") -> None:
    """One file a batch, in order; each batch's rows are sorted."""
    for start, end in bounds:
        rows.where((F.col(t) >= start) & (F.col(t) < end)).coalesce(1).sortWithinPartitions(t).write.mode("append").parquet(folder)


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The stream of the batches, one file a trigger, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def replay(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """``each`` gets every batch that is there, one after another; a later call goes on after the last one."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow_mixture(stream: DataFrame, attributes: Sequence[str], initial: int, trigger: int = 200, key: str = "stream_id", t: str = "t") -> DataFrame:
    """(key, t, component, uncertain): each key's rows in order of t, assigned by a mixture that they change.

    The first ``initial`` rows of a key fit its mixture; until they are there, they wait in its state.
    Order matters within a key, so keys are what runs side by side.
    """
    names = list(attributes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
        follower = I.Follower.loaded(kept) if kept else None
        rows = pd.concat(list(batches)).sort_values(t)
        out = []
        for number, x in zip(rows[t].tolist(), rows[names].to_numpy(float), strict=True):
            if follower is None:
                waiting.append([number, x.tolist()])
                if len(waiting) == initial:
                    first = np.array([r for _, r in waiting])
                    follower = I.Follower(I.best_by_bic(first), first, trigger)
                    best = I.gaussians(follower.comps).score(first, True).argmin(axis=1)
                    out += [(n, int(k), False) for (n, _), k in zip(waiting, best, strict=True)]
                    waiting = []
            else:
                out.append((number, *follower.add(x)))
        state.update((follower.dump() if follower else None, json.dumps(waiting)))
        yield pd.DataFrame({key: [k[0]] * len(out), t: [r[0] for r in out], "component": [r[1] for r in out], "uncertain": [r[2] for r in out]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {t} long, component int, uncertain boolean", "follower string, waiting string", "append", GroupStateTimeout.NoTimeout)
