"""Positions in a global order, without a single-task window and without a job while the query is built.

``row_number() over (order by ...)`` moves the whole table into one task. Here
a spread-out sample of the order gives bounds, which come to the plan as one
scalar array; each row finds its bucket among them by binary search, buckets
number their own rows, and only the bucket totals are summed up to get the
offsets. Bounds and buckets depend on the rows' values alone, so a task that is
run again gives the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the order: one for each slot of the hash that has a row. Buckets are one more at most.
_BOUNDS = 4096


def _named(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _bucketed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_bucket``: how many bounds lie at or below the row. NULLs come first."""
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    hashed = F.xxhash64(*order)
    slots = df.select(key.alias("_key"), hashed.alias("_hash")).groupBy(F.pmod("_hash", F.lit(_BOUNDS))).agg(F.min_by("_key", "_hash").alias("_bound"))
    bounds = slots.agg(F.array_sort(F.collect_list("_bound")).alias("_bounds")).scalar()
    steps = F.array(*[F.lit(_BOUNDS >> i) for i in range(_BOUNDS.bit_length())])
    below = lambda b, at: F.get(b["bounds"], at - 1) <= b["key"]
    search = lambda b: F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= F.size(b["bounds"])) & below(b, low + s), low + s).otherwise(low))
    held = F.array(F.struct(key.alias("key"), F.col("_bounds").alias("bounds")))
    return df.withColumn("_bounds", bounds).withColumn("_bucket", F.get(F.transform(held, search), F.lit(0))).drop("_bounds")


def _before(totals: DataFrame, amount: str) -> DataFrame:
    """Total of ``amount`` over the buckets before each one."""
    # One row per bucket: the window and the broadcast are bounded by the number of bounds, whatever the table holds.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_bucket", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias("_before")))


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row; ``order`` must be unique and ascending."""
    columns = _named(order)
    rows = _bucketed(df, columns)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns)) - 1
    numbered = rows.withColumn("_local", local).join(_before(sizes, "_rows"), "_bucket")
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def with_group_position(
    df: DataFrame, keys: Sequence[str], *order: Column | str, name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row within its group.

    A group may span any number of buckets, so no task ever holds a hot group.
    Only groups that span several need the rows before: at most one of them
    goes on into each bucket, so these offsets are no more than buckets.
    """
    columns = _named(order)
    rows = _bucketed(df, [*_named(keys), *columns])
    sizes = rows.groupBy("_bucket", *keys).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.sum("_rows").over(earlier)).where("_before is not null")
    before = before.select(F.col("_bucket").alias("_b"), *[F.col(k).alias(f"_key_{k}") for k in keys], "_before")
    local = F.row_number().over(Window.partitionBy("_bucket", *keys).orderBy(*columns)) - 1
    same = [F.col("_bucket") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    numbered = rows.withColumn("_local", local).join(F.broadcast(before), same, "left")
    return numbered.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_local")).drop("_bucket", "_local", *before.columns)


def with_running_sum(
    df: DataFrame, amount: str, *order: Column | str, name: str = "running"
) -> DataFrame:
    """Add the inclusive running sum of ``amount`` in a unique global order."""
    columns = _named(order)
    rows = _bucketed(df, columns)
    totals = rows.groupBy("_bucket").agg(F.sum(amount).alias("_amount"))
    local = F.sum(amount).over(Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("_local", local).join(_before(totals, "_amount"), "_bucket")
    return summed.withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")
