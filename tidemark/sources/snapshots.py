"""Named snapshots of tables as Parquet: what a session saves and restores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .kept import shared_dir


class Snapshots:
    """Tables under one folder, each snapshot under a name of its own making.

    The folder is spark.checkpoint.dir where it is set, which all executors share.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{folder or shared_dir(spark)}/snapshots"

    def save(self, tables: Mapping[str, DataFrame]) -> str:
        name = uuid.uuid4().hex
        for key, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{key}")
        content = self.spark.createDataFrame([(json.dumps(sorted(tables)),)], "content string")
        content.coalesce(1).write.text(f"{self.folder}/{name}/content")
        return name

    def load(self, name: str) -> dict[str, DataFrame]:
        if not name.isalnum():
            raise ValueError(f"no snapshot's name: {name!r}")
        content = json.loads(self.spark.read.text(f"{self.folder}/{name}/content").first()[0])
        return {key: self.spark.read.parquet(f"{self.folder}/{name}/{key}") for key in content}
