"""What the corpus operators share: tables kept between jobs, and the processes of Python workers."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources.kept import drop, keep, new_path, shared_dir

__all__ = ["drop", "join_groups", "keep", "new_path", "of_worker", "partitions", "release", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of ``rows`` at most: thousands of whole texts at once take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def of_worker(key: Hashable, make: Callable):
    """What ``make`` gives, made once in this worker's process and kept for its later tasks."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def join_groups(rows: DataFrame, groups: DataFrame, on: Column) -> DataFrame:
    """``rows`` with their group's row, of counts or least values by key.

    A group may hold a large part of all rows. The groups are written first: then both sides of the join are
    plain exchanges, of which adaptive execution splits the large partitions.
    """
    return rows.join(keep(groups, "groups"), on)


def release(keep_made: bool = False) -> None:
    """Give back what earlier tasks left in this worker's process: things made by ``of_worker``, and freed memory."""
    kept = sys.modules.get("_tidemark_worker")
    if kept is not None and not keep_made:
        kept.__dict__.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
