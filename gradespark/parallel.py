"""Spreading a scan that has too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan whose splits cannot keep the cores busy.

    A file with one row group is one task, which is too few for work that
    costs much per row. Tables with at least one split per core pass through
    without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.hint("rebalance") if df.rdd.getNumPartitions() < cores else df
