"""Scans and sinks of the formats that streams come in: CSV, JSON, arrays of numpy, markup."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, t: str = "t") -> DataFrame:
    """Rows of a CSV with a header, by a given schema: nothing is inferred.

    ``t`` is a column of the file; a file without one gets the numbers of its lines, for which it is read
    as one partition, as the order of lines is known to no other reader.
    """
    rows = spark.read.schema(schema).csv(path, header=True)
    rows = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(c) for c, k in ((f.name, f.dataType) for f in rows.schema.fields)])
    return rows if t in rows.columns else rows.coalesce(1).withColumn(t, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


#: Rows that a task passes on at a time.
_ROWS = 1 << 16


def _parsed(spark: SparkSession, path: str, schema: str, columns: Callable[[bytes], list[np.ndarray]]) -> DataFrame:
    """Rows of a file (or of all files of a folder) by Spark's own reader, whatever store it is in; a file is a task's and none goes to the driver."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = columns(content.as_py())
                for at in range(0, len(found[0]), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _ROWS]) for c in found], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def scan_npz(spark: SparkSession, path: str) -> DataFrame:
    """(doc_idx, term_idx, weight) of a compressed sparse matrix."""

    def columns(content: bytes) -> list[np.ndarray]:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            indptr, indices, data = z["indptr"], z["indices"], z["data"]
        return [np.repeat(np.arange(len(indptr) - 1, dtype=np.int64), np.diff(indptr)), indices.astype(np.int32), data.astype(np.float64)]

    return _parsed(spark, path, "doc_idx long, term_idx int, weight double", columns)


def scan_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term_idx, term) of a JSON list."""

    def columns(content: bytes) -> list[np.ndarray]:
        terms = json.loads(content)
        return [np.arange(len(terms), dtype=np.int32), np.array(terms, object)]

    return _parsed(spark, path, "term_idx int, term string", columns)


def scan_flags(spark: SparkSession, path: str) -> DataFrame:
    """(fold, t, is_train) of a boolean matrix of folds by rows."""

    def columns(content: bytes) -> list[np.ndarray]:
        flags = np.load(io.BytesIO(content), allow_pickle=False).astype(bool)
        fold, t = np.indices(flags.shape)
        return [fold.ravel().astype(np.int32), t.ravel().astype(np.int64), flags.ravel()]

    return _parsed(spark, path, "fold int, t long, is_train boolean", columns)


def svg(template: Sequence[str], markup: Column, *values: Column) -> Column:
    """Markup without data-content attributes, with values between a template's pieces."""
    clean = F.regexp_replace(markup, ' data-content="[^"]*"', "")
    parts = [F.lit(template[0])]
    for piece, value in zip(template[1:], [*values, clean], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)
