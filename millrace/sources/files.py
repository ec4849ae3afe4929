"""File sources by format or suffix, and the slicing of a source into micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "jsonl")
_SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "jsonl"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and inferred types; empty cells of text columns are empty texts, not nulls."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """A dataset that is held as an Arrow table, such as one of a dataset hub's library."""
    return spark.createDataFrame(table.to_pandas())


def format_of(path: str, fmt: str = "auto") -> str:
    if fmt != "auto":
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
        return fmt
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in _SUFFIXES:
        raise ValueError(f"cannot tell the format of {path!r} by its suffix {suffix!r}")
    return _SUFFIXES[suffix]


def open_source(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    reader = {"parquet": read_parquet, "csv": read_csv, "jsonl": read_jsonl}[format_of(path, fmt)]
    return reader(spark, path)


def batch_numbers(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with ``_batch``: rows in ``order`` framed into batches of ``size``. The framing is part of a batch's identity."""
    from millrace.operators.ordering import dense_rank_ids

    if size < 1:
        raise ValueError("batch size must be positive")
    return dense_rank_ids(df, order, "_position").withColumn("_batch", F.floor(F.col("_position") / size))
