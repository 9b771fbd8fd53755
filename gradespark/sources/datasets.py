"""Task suites from files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the two known suites.
HUMANEVAL_SCHEMA = (
    "task_id string, prompt string, canonical_solution string, test string, entry_point string"
)
MBPP_SCHEMA = "task_id string, text string, code string, test_list array<string>"


def only_split(rows: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """The rows of one split; all rows if none is named."""
    return rows if split is None else rows.where(F.col(column) == split).drop(column)


def _load(spark: SparkSession, path: str, fmt: str, schema: str, split: str | None) -> DataFrame:
    # A split is a folder (split=test): partition pruning reads only its files.
    schema = schema + ", split string" if split is not None else schema
    return only_split(spark.read.schema(schema).format(fmt).load(path), split)


def load_humaneval(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    return _load(spark, path, fmt, HUMANEVAL_SCHEMA, split)


def load_mbpp(
    spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    return _load(spark, path, fmt, MBPP_SCHEMA, split)


def load_custom(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Any suite with a ``prompt`` column; without a split all splits are read."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return only_split(reader.load(path), split)
