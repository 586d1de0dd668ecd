"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


for _name in ("prepare", "windows", "pairs", "drift", "mixture", "ensemble", "text", "views", "layout", "fitted"):
    importlib.import_module(f"tidemark.plans.{_name}")
