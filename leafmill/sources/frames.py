"""Rows of files: a Python function applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def rows_from(frame: DataFrame, columns: list[str | Column], schema: str, made: Callable[..., Iterable[tuple]]) -> DataFrame:
    """The rows that ``made`` gives for the values of ``columns``, row by row; batches stay small, as files are large."""
    names = [f.name for f in StructType.fromDDL(schema).fields]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows, size = [], 0
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in made(*values):
                    rows.append(dict(zip(names, row, strict=True)))
                    size += 100 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return frame.select(*columns).mapInArrow(batches, schema)


def list_files(spark: SparkSession, path: str, max_bytes: int = 250 << 20) -> DataFrame:
    """(path, name, size, error_code) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.when(F.col("length") > max_bytes, "INPUT_TOO_LARGE").alias("error_code"))


def read_files(spark: SparkSession, path: str, max_bytes: int = 250 << 20) -> DataFrame:
    """(path, length, content) of files of at most ``max_bytes``; the bound reaches the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= max_bytes).select("path", "length", "content")


def walk_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, relative_path, size, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    return files.select("path", F.substring(inside, F.length(F.lit(path.rstrip("/"))) + 2, F.length(inside)).alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
